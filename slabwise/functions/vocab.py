"""Vocabularies, patterns and weights that scoring results depend on."""

# Vessel names looked for by plain containment, in reporting order.
VESSEL_TERMS = [
    "aca", "anterior cerebral artery", "mca", "middle cerebral artery", "pca", "posterior cerebral artery",
    "ica", "internal carotid", "vertebral", "basilar", "posterior circulation",
]
OVERCONFIDENT = ["definitely", "certainly", "absolutely", "clearly", "unambiguous", "without doubt", "undeniably"]
UNCERTAIN = ["possible", "possibly", "may", "might", "could", "suggestive", "suspicious", "likely", "probably", "cannot exclude", "not excluded"]
NORMAL_TERMS = ["no abnormality", "normal", "unremarkable"]
FINDING_TERMS = ["occlusion", "stenosis", "thrombus", "embolus", "cutoff", "filling defect"]

# Canonical vessels with what names them, in priority order.
VESSEL_PATTERNS = {
    "ica": r"\b(ica|internal carotid(?: artery)?)\b",
    "mca": r"\b(mca|middle cerebral(?: artery)?|m1|m2)\b",
    "aca": r"\b(aca|anterior cerebral(?: artery)?|a1|a2)\b",
    "pca": r"\b(pca|posterior cerebral(?: artery)?|p1|p2)\b",
    "basilar": r"\b(basilar(?: artery)?)\b",
    "vertebral": r"\b(vertebral(?: artery)?|v4)\b",
}
POSITIVE = (
    r"\b(?:occlusion\b|occluded\b|occlusive\b|thrombus\b|thrombosis\b|embol|clot\b|cut[- ]?off\b|filling defect\b|non[- ]?opacif"
    r"|large[- ]vessel occlusion\b|lvo\b|high[- ]grade stenosis\b|flow[- ]limiting stenosis\b)"
)
NEGATIVE = (
    r"\b(?:no (?:definite |evidence of )?(?:proximal |large[- ]vessel )?(?:occlusion|cutoff|filling defect|thrombus)\b|no large[- ]vessel occlusion\b|no lvo\b"
    r"|patent\b|unremarkable\b|no acute\b|no significant\b|within normal limits\b|normal (?:vascular|opacification|caliber)\b)"
)
HEDGE = (
    r"\b(?:limited\b|partial(?:ly)?\b|correlate\b|may\b|might\b|possible\b|possibly\b|suggestive\b|cannot (?:exclude|rule out)\b"
    r"|not excluded\b|if clinically\b|equivocal\b)"
)
NEGATION = r"\b(no|not|without|negative|absence|absent|patent|unremarkable|normal|none|rule out|ruled out|exclude[ds]?)\b"
CLAUSE_END = r"[.;:,\n]"

# White space as Python sees it.
_SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"
BLANK = _SPACE + "+"

IMPRESSION = rf"impression{_SPACE}*:"
VASCULAR = rf"vascular{_SPACE}+(summary|findings){_SPACE}*:"
IMPRESSION_TEXT = rf"impression{_SPACE}*:(.+?)(?:\n[\p{{L}}\p{{N}}_]+:|\n?\z)"

RUBRIC_WEIGHTS = {"hallucination": 0.4, "consistency": 0.35, "uncertainty": 0.25}
RULE_WEIGHTS = {"structure": 0.3, "clinical": 0.4, "similarity": 0.3}
FACT_WEIGHTS = {"detection": 0.45, "vessel": 0.20, "side": 0.25, "calibration": 0.10}
COMPOSITE_WEIGHTS = {"fact": 0.5, "judge": 0.3, "structure": 0.1, "similarity": 0.1}
JUDGE_AXES = ["correctness", "grounding", "laterality", "calibration"]
LEAK_MARKERS = ["<|image", "<|vision", "<|video", "image_pad", "<image>"]
CONVERSATION_MARKS = ["assistant\n", "Assistant:", "<|im_start|>assistant"]
