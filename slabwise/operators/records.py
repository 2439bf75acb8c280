"""Chat and trainer records, label masks, configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slabwise.functions.text import strip
from slabwise.functions.vocab import CONVERSATION_MARKS, LEAK_MARKERS

MAX_IMAGES = 4
IGNORE = -100
_PART = "struct<type:string,text:string>"


def image_prefix(images: Column | str, most: int = MAX_IMAGES) -> Column:
    c = F.col(images) if isinstance(images, str) else images
    return F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, most)


def message(role: str, text: Column | str, n_images: Column | None = None) -> Column:
    """struct(role, content): n image parts, then the text part."""
    t = F.col(text) if isinstance(text, str) else text
    image = F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"))
    words = F.array(F.struct(F.lit("text").alias("type"), t.alias("text")))
    content = words if n_images is None else F.concat(F.array_repeat(image, n_images), words)
    return F.struct(F.lit(role).alias("role"), content.cast(f"array<{_PART}>").alias("content"))


def conversation(prompt: Column | str, images: Column | str, response: Column | str | None = None, most: int = MAX_IMAGES) -> Column:
    """User turn with up to `most` image parts, and the assistant's turn where there is a response."""
    user = message("user", prompt, F.size(image_prefix(images, most)))
    return F.array(user) if response is None else F.array(user, message("assistant", response))


def split_conversation(text: Column | str) -> Column:
    """struct(prompt, response): cut at the first mark, in order of priority, that the text holds,
    both sides stripped; the whole text and '' without one. Case counts."""
    t = F.col(text) if isinstance(text, str) else text
    out = F.struct(t.alias("prompt"), F.lit("").alias("response"))
    for mark in reversed(CONVERSATION_MARKS):
        at = F.locate(mark, t)
        rest = at + len(mark)
        cut = F.struct(strip(F.substring(t, F.lit(1), at - 1)).alias("prompt"), strip(F.substring(t, rest, F.length(t))).alias("response"))
        out = F.when(at > 0, cut).otherwise(out)
    return out


def label_mask(ids: Column | str, attention: Column | str, prompt_len: Column | str, left_padded: Column | str) -> Column:
    """Labels of a token row: padding and the prompt's tokens ignored. The prompt starts behind the
    padding of a left-padded row, else at 0."""
    i, a, p, left = (F.col(x) if isinstance(x, str) else x for x in (ids, attention, prompt_len, left_padded))
    start = F.when(left, F.size(F.filter(a, lambda x: x == 0))).otherwise(F.lit(0))
    return F.transform(i, lambda x, k: F.when((F.get(a, k) == 0) | ((k >= start) & (k < start + p)), F.lit(IGNORE)).otherwise(x))


def mask_report(supervised: Column | str, supervised_raw: Column | str, expected: Column | str) -> Column:
    """struct(covers, leaked, ok): whether the supervised text holds the response and nothing leaked."""
    s, raw, e = (F.col(x) if isinstance(x, str) else x for x in (supervised, supervised_raw, expected))
    s, e = strip(s), strip(e)
    covers = F.contains(s, F.left(e, F.lit(50))) | F.contains(e, F.left(s, F.lit(50)))
    leaked = F.exists(F.array(*map(F.lit, LEAK_MARKERS)), lambda m: F.contains(raw, m))
    return F.struct(covers.alias("covers"), leaked.alias("leaked"), (covers & ~leaked).alias("ok"))


def data_uri(content: Column | str, path: Column | str) -> Column:
    """data:image/<mime>;base64,<content>; null for null content. jpg is jpeg; no extension is png."""
    c, p = (F.col(x) if isinstance(x, str) else x for x in (content, path))
    ext = F.lower(F.regexp_extract(p, r"\.([^./\\]+)$", 1))
    mime = F.when(ext.isin("jpg", "jpeg"), "jpeg").when(ext == "", "png").otherwise(ext)
    return F.concat(F.lit("data:image/"), mime, F.lit(";base64,"), F.base64(c))


def append_reference(df: DataFrame, candidates: str, reference: str) -> DataFrame:
    """The reference, where there is one, as a last candidate."""
    c, r = F.col(candidates), F.col(reference)
    extra = F.struct(r.alias("text"), F.lit(None).cast("double").alias("temperature"), F.size(c).alias("index"), F.lit(True).alias("is_reference"))
    return df.withColumn(candidates, F.when(F.length(r) > 0, F.array_append(c, extra)).otherwise(c))


def number_list(text: Column | str, kind: str = "int") -> Column:
    """Numbers of a comma list. Blanks between commas are left out of whole numbers and make a list of
    other numbers an error, as does a list of whole numbers without any."""
    t = F.col(text) if isinstance(text, str) else text
    if kind != "int":
        return F.transform(F.split(t, ","), lambda x: F.trim(x).cast(kind))
    listed = F.filter(F.transform(F.split(t, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(listed) == 0, F.raise_error(F.lit("a list of numbers is empty"))).otherwise(F.transform(listed, lambda x: x.cast(kind)))


def reporters(text: Column | str) -> Column:
    """A comma list of reporter names, trimmed; none-like values give an empty array."""
    t = F.col(text) if isinstance(text, str) else text
    none = t.isNull() | F.lower(F.trim(t)).isin("", "none", "null")
    return F.when(none, F.array().cast("array<string>")).otherwise(F.filter(F.transform(F.split(t, ","), lambda x: F.trim(x)), lambda x: x != ""))


def gib(n: Column | str) -> Column:
    b = F.col(n) if isinstance(n, str) else n
    return F.format_string("%.2f GiB", b / F.lit(1024.0**3))


#: Configuration sections, their keys and defaults. None is an optional text.
CONFIG: dict[str, dict[str, object]] = {
    "model": {
        "model_name_or_path": "Qwen/Qwen2-VL-7B-Instruct", "model_type": "auto", "trust_remote_code": True, "torch_dtype": "bfloat16", "attn_implementation": "flash_attention_2",
        "use_qlora": True, "load_in_4bit": True, "bnb_4bit_compute_dtype": "bfloat16", "bnb_4bit_use_double_quant": True, "bnb_4bit_quant_type": "nf4",
    },
    "lora": {
        "use_lora": True, "r": 64, "lora_alpha": 128, "lora_dropout": 0.05, "bias": "none", "task_type": "CAUSAL_LM",
        "target_modules": ["q_proj", "k_proj", "v_proj", "o_proj", "gate_proj", "up_proj", "down_proj"], "modules_to_save": ["embed_tokens", "lm_head"],
    },
    "distributed": {
        "strategy": "single", "ddp_find_unused_parameters": None, "fsdp": [], "fsdp_min_num_params": 0, "fsdp_transformer_layer_cls_to_wrap": [], "fsdp_backward_prefetch": "backward_pre", "fsdp_forward_prefetch": False,
        "fsdp_cpu_ram_efficient_loading": True, "fsdp_offload_params": False, "fsdp_sync_module_states": True, "fsdp_use_orig_params": True, "fsdp_activation_checkpointing": False,
    },
    "data": {
        "train_jsonl": "data/train.jsonl", "val_jsonl": "data/val.jsonl", "test_jsonl": "data/test.jsonl", "images_root": "data/images", "image_size": 448, "max_images_per_case": 4,
        "max_seq_length": 2048, "max_prompt_length": 512, "max_response_length": 1024,
    },
    "training": {
        "output_dir": "outputs/sft", "num_train_epochs": 3, "per_device_train_batch_size": 1, "per_device_eval_batch_size": 1, "gradient_accumulation_steps": 8, "learning_rate": 2e-4, "weight_decay": 0.01, "warmup_ratio": 0.03,
        "lr_scheduler_type": "cosine", "logging_steps": 10, "eval_steps": 100, "save_steps": 500, "save_total_limit": 3, "eval_strategy": "steps", "load_best_model_at_end": True, "metric_for_best_model": "eval_loss",
        "greater_is_better": False, "seed": 42, "bf16": True, "fp16": False, "gradient_checkpointing": True, "dataloader_num_workers": 4, "remove_unused_columns": False, "report_to": ["tensorboard", "wandb"],
    },
    "generation": {"num_candidates": 4, "max_new_tokens": 512, "temperature": 0.7, "top_p": 0.9, "top_k": 50, "do_sample": True, "repetition_penalty": 1.1},
    "alignment": {
        "alignment_type": "dpo", "output_dir": "outputs/alignment", "beta": 0.1, "label_smoothing": 0.0, "desirable_weight": 1.0, "undesirable_weight": 1.0, "orpo_alpha": 1.0, "grpo_group_size": 4, "grpo_epsilon": 0.2,
        "num_train_epochs": 1, "per_device_train_batch_size": 1, "gradient_accumulation_steps": 8, "learning_rate": 5e-5, "weight_decay": 0.01, "warmup_ratio": 0.1, "lr_scheduler_type": "cosine", "logging_steps": 10,
        "save_steps": 500, "save_total_limit": 3, "seed": 42, "bf16": True, "fp16": False, "gradient_checkpointing": True, "dataloader_num_workers": 4, "remove_unused_columns": False, "report_to": ["tensorboard"],
    },
    "evaluation": {
        "output_dir": "outputs/evaluation", "metrics": ["bleu", "rouge", "structural", "clinical"], "hallucination_weight": 1.0, "consistency_weight": 1.0, "uncertainty_weight": 0.5, "use_llm_judge": False, "llm_judge_model": None,
    },
}
_KINDS = {bool: "boolean", int: "int", float: "double", str: "string", list: "array<string>", type(None): "string"}


def _literal(value: object) -> Column:
    kind = _KINDS[type(value)]
    return F.array(*map(F.lit, value)).cast(kind) if isinstance(value, list) else F.lit(value).cast(kind)


def config(json: Column | str, overrides: dict[str, object] | None = None) -> Column:
    """struct of sections of the configured values: an override (by 'section.key') beats the file, the file
    the default."""
    j = F.col(json) if isinstance(json, str) else json
    over, sections = overrides or {}, []
    strange = [k for k in over if k.partition(".")[2] not in CONFIG.get(k.partition(".")[0], {})]
    if strange:
        raise ValueError(f"unknown settings {strange}")
    for section, keys in CONFIG.items():
        out = []
        for k, default in keys.items():
            kind, path = _KINDS[type(default)], F.get_json_object(j, f"$.{section}.{k}")
            given = F.from_json(path, kind) if isinstance(default, list) else path.cast(kind)
            first = [_literal(over[f"{section}.{k}"]).cast(kind)] if over.get(f"{section}.{k}") is not None else []
            out.append(F.coalesce(*first, given, _literal(default)).alias(k))
        sections.append(F.struct(*out).alias(section))
    return F.struct(*sections)


def unknown_settings(json: Column | str) -> Column:
    """What the configuration does not know, as 'section' or 'section.key', sorted; loading must refuse it."""
    j = F.col(json) if isinstance(json, str) else json
    out = [F.array_except(F.coalesce(F.json_object_keys(j), F.array().cast("array<string>")), F.array(*map(F.lit, CONFIG)))]
    for section, keys in CONFIG.items():
        mine = F.coalesce(F.json_object_keys(F.get_json_object(j, f"$.{section}")), F.array().cast("array<string>"))
        named = F.array_join(F.array_except(mine, F.array(*map(F.lit, keys))), f"|{section}.")
        out.append(F.when(named == "", F.array().cast("array<string>")).otherwise(F.split(F.concat(F.lit(f"{section}."), named), r"\|")))
    return F.array_sort(F.concat(*out))


def load_config(json: Column | str, overrides: dict[str, object] | None = None) -> Column:
    """config, refusing text with unknown settings."""
    bad = unknown_settings(json)
    return F.when(F.size(bad) > 0, F.raise_error(F.concat(F.lit("unknown settings: "), F.array_join(bad, ", ")))).otherwise(config(json, overrides))


def config_json(json: Column | str, overrides: dict[str, object] | None = None) -> Column:
    """The whole configuration as JSON text, every key written, as an echo beside results."""
    return F.to_json(config(json, overrides), {"ignoreNullFields": "false"})
