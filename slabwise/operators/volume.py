"""Maximum-intensity projections of voxel tables (patient, y, x, z, hu), with coverage records.

Everything is one aggregation per step, keyed by patient, so patients spread over the cluster
and a volume is never gathered in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD, PAD_MM = -500.0, 10.0
FLOOR = -100.0
LOW, HIGH, BACKGROUND = 30.0, 420.0, -1000.0
LEVEL, WIDTH = 200.0, 470.0
VIEWS = {"axial": ("z", "y", "x"), "coronal": ("y", "z", "x"), "sagittal": ("x", "z", "y")}  # slab axis, row, column


def crop_box(voxels: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), threshold: float = THRESHOLD, pad_mm: float = PAD_MM) -> DataFrame:
    """(patient, y0, y1, x0, x1, z0, z1): bounds of the foreground with padding (spacing dx, dy, dz),
    inside the volume; the whole volume without foreground."""
    fg = F.col("hu") > F.lit(threshold)
    aggs, out = [], ["patient"]
    for a in "yxz":
        aggs += [F.min(F.when(fg, F.col(a))).alias(f"l{a}"), F.max(F.when(fg, F.col(a))).alias(f"h{a}"), F.min(a).alias(f"f{a}"), F.max(a).alias(f"t{a}")]
    b = voxels.groupBy("patient").agg(*aggs)
    for a, mm in zip("yxz", (spacing[1], spacing[0], spacing[2])):
        pad = F.lit(round(pad_mm / mm))
        out += [F.coalesce(F.greatest(F.col(f"f{a}"), F.col(f"l{a}") - pad), F.col(f"f{a}")).cast("int").alias(f"{a}0"), F.coalesce(F.least(F.col(f"t{a}"), F.col(f"h{a}") + pad), F.col(f"t{a}")).cast("int").alias(f"{a}1")]
    return b.select(*out)


def trim_range(voxels: DataFrame, floor: float = FLOOR, area_frac: float = 0.0, drop_bottom: float = 0.0, drop_top: float = 0.0) -> DataFrame:
    """(patient, z0, z1): from the first to the last slice whose foreground area reaches area_frac of
    the largest, less the given fractions at the bottom and the top."""
    area = voxels.groupBy("patient", "z").agg(F.count_if(F.col("hu") > floor).alias("area"))
    top = area.groupBy("patient").agg(F.max("area").alias("top"), F.max("z").alias("last"))
    j = area.join(top, "patient")
    keep = (F.lit(area_frac) <= 0) | (F.col("top") == 0) | (F.col("area") >= F.lit(area_frac) * F.col("top"))
    r = j.groupBy("patient").agg(F.min(F.when(keep, F.col("z"))).alias("a"), F.max(F.when(keep, F.col("z"))).alias("b"), F.first("last").alias("last"))
    span = F.col("b") - F.col("a") + 1
    z0 = F.greatest(F.lit(0), F.least(F.col("a") + F.rint(drop_bottom * span).cast("int"), F.col("last")))
    z1 = F.col("b") - F.rint(drop_top * span).cast("int")
    return r.select("patient", z0.cast("int").alias("z0"), F.greatest(z0, F.least(z1, F.col("last"))).cast("int").alias("z1"))


def hu_filter(hu: Column | str, mode: str = "low_clip", low: float = LOW, high: float = HIGH, background: float = BACKGROUND) -> Column:
    h = F.col(hu) if isinstance(hu, str) else hu
    bg, hi = F.lit(background).cast("float"), F.lit(high).cast("float")
    if mode == "none":
        return h
    if mode == "bandpass":
        return F.when((h < low) | (h > high), bg).otherwise(h)
    if mode == "low":
        return F.when(h < low, bg).otherwise(h)
    if mode == "clip":
        return F.when(h > high, hi).otherwise(h)
    if mode == "low_clip":
        return F.when(h < low, bg).when(h > high, hi).otherwise(h)
    raise ValueError(f"unknown mode {mode}")


def percentiles(voxels: DataFrame, low: float = 0.01, high: float = 0.995, floor: float = FLOOR) -> DataFrame:
    """(patient, lo, hi): exact, linearly interpolated, over the foreground; (0, 1) without any."""
    p = voxels.groupBy("patient").agg(F.expr(f"percentile(cast(hu as double), array({low}D, {high}D)) FILTER (WHERE hu > {floor}D)").alias("p"))
    lo, hi = F.coalesce(F.get("p", F.lit(0)), F.lit(0.0)), F.coalesce(F.get("p", F.lit(1)), F.lit(1.0))
    return p.select("patient", lo.alias("lo"), F.when(hi > lo, hi).otherwise(lo + 1.0).alias("hi"))


def to_pixel(hu: Column | str, lo: Column, hi: Column) -> Column:
    """8-bit value of a density between lo and hi (truncated)."""
    h = F.col(hu) if isinstance(hu, str) else hu
    h = F.greatest(lo, F.least(hi, h.cast("double")))
    return ((h - lo) / (hi - lo + F.lit(1e-6)) * 255.0).cast("int")


def window_bounds(level: float = LEVEL, width: float = WIDTH) -> tuple[Column, Column]:
    return F.lit(level - width / 2.0), F.lit(level + width / 2.0)


def slab_edges(n: Column | str, k: int) -> Column:
    """The k + 1 edges of k equal slabs of [0, n); k is kept between 1 and n. Halves round to even."""
    c = F.col(n) if isinstance(n, str) else n
    kk = F.greatest(F.lit(1), F.least(F.lit(k), c))
    return F.transform(F.sequence(F.lit(0), kk), lambda i: F.rint(i * c / kk).cast("int"))


def slabs(shape: DataFrame, k: int, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), include_global: bool = True) -> DataFrame:
    """Coverage records of every image: shape (patient, h, w, n) -> patient, view, axis, slab_index,
    slabs_total, lo, hi, mm_lo, mm_hi, frac_lo, frac_hi, coverage_band, side."""
    length = {"axial": ("n", "Z", spacing[2]), "coronal": ("h", "Y", spacing[1]), "sagittal": ("w", "X", spacing[0])}
    parts = []
    for view, (size, axis, mm) in length.items():
        e = shape.select("patient", F.col(size).alias("len"), slab_edges(size, k).alias("e"))
        s = e.select("patient", "len", F.posexplode(F.transform(F.slice("e", 1, F.size("e") - 1), lambda x, i: F.struct(x.alias("lo"), F.get(F.col("e"), i + 1).alias("hi")))).alias("slab_index", "r"))
        lo, hi, n = F.col("r.lo"), F.col("r.hi"), F.greatest("len", F.lit(1))
        c = ((lo + hi) / 2.0) / n
        band = {
            "axial": F.when(c < F.lit(1 / 3), "inferior").when(c > F.lit(2 / 3), "superior").otherwise("middle"),
            "coronal": F.when(c < F.lit(1 / 3), "anterior").when(c > F.lit(2 / 3), "posterior").otherwise("middle"),
            "sagittal": F.lit(None).cast("string"),
        }[view]
        sided = F.when(c < 0.4, "right").when(c > 0.6, "left").otherwise("midline") if view == "sagittal" else F.lit(None).cast("string")
        parts.append(s.select(
            "patient", F.lit(view).alias("view"), F.lit(axis).alias("axis"), "slab_index", F.lit(k).alias("slabs_total"), lo.alias("lo"), hi.alias("hi"),
            F.round(lo * F.lit(mm), 2).alias("mm_lo"), F.round(hi * F.lit(mm), 2).alias("mm_hi"), F.round(lo / n, 4).alias("frac_lo"), F.round(hi / n, 4).alias("frac_hi"), band.alias("coverage_band"), sided.alias("side"),
        ))
        if include_global:
            nothing = F.lit(None).cast("double")
            parts.append(shape.select(
                "patient", F.lit(f"global_{view}").alias("view"), F.lit(axis).alias("axis"), F.lit(0).alias("slab_index"), F.lit(1).alias("slabs_total"), F.lit(0).alias("lo"), F.col(size).alias("hi"),
                nothing.alias("mm_lo"), nothing.alias("mm_hi"), F.lit(0.0).alias("frac_lo"), F.lit(1.0).alias("frac_hi"),
                F.lit(None if view == "sagittal" else "all").cast("string").alias("coverage_band"), F.lit("both" if view == "sagittal" else None).cast("string").alias("side"),
            ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def shape_of(voxels: DataFrame) -> DataFrame:
    return voxels.groupBy("patient").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), (F.max("z") + 1).alias("n"))


def project(voxels: DataFrame, k: int) -> DataFrame:
    """(patient, view, slab_index, row, col, hu): slab maxima in all three views in one pass: every
    voxel is sent to its three pixels, maxima are taken before the shuffle."""
    edges = shape_of(voxels).select("patient", *[slab_edges(s, k).alias(f"e_{v}") for v, s in (("axial", "n"), ("coronal", "h"), ("sagittal", "w"))])
    v = voxels.join(edges, "patient")

    def slab(view: str) -> Column:
        axis = VIEWS[view][0]
        return F.size(F.filter(F.slice(f"e_{view}", 2, F.size(f"e_{view}") - 1), lambda e: e <= F.col(axis)))

    each = F.array(*[F.struct(F.lit(n).alias("view"), slab(n).alias("slab_index"), F.col(r).alias("row"), F.col(c).alias("col")) for n, (_, r, c) in VIEWS.items()])
    flat = v.select("patient", "hu", F.explode(each).alias("p")).select("patient", "p.*", "hu")
    return flat.groupBy("patient", "view", "slab_index", "row", "col").agg(F.max("hu").alias("hu"))


def project_global(voxels: DataFrame) -> DataFrame:
    """(patient, view, row, col, hu): maxima over the whole volume in the three views."""
    each = F.array(*[F.struct(F.lit(f"global_{n}").alias("view"), F.col(r).alias("row"), F.col(c).alias("col")) for n, (_, r, c) in VIEWS.items()])
    flat = voxels.select("patient", "hu", F.explode(each).alias("p")).select("patient", "p.*", "hu")
    return flat.groupBy("patient", "view", "row", "col").agg(F.max("hu").alias("hu"))


def image_budget(k: int, include_global: bool) -> int:
    return 3 * max(1, k) + (3 if include_global else 0)


def config_name(k: int, include_global: bool) -> str:
    return f"slabs{k}" + ("_global" if include_global else "")


def file_name(view: Column | str, index: Column | str, total: Column | str) -> Column:
    v, i, t = (F.col(x) if isinstance(x, str) else x for x in (view, index, total))
    return F.when(v.startswith("global_"), F.concat(F.lit("global/"), v, F.lit(".png"))).otherwise(F.concat(v, F.lit("/"), v, F.format_string("_slab_%02d_of_%d.png", i, t)))


def manifest(records: DataFrame, budget: int, without_first_axial: bool = False) -> DataFrame:
    """(patient, image_budget, n_images, images): per patient the paths of its images in order,
    optionally without the first axial slab."""
    r = records.filter(~((F.col("view") == "axial") & (F.col("slab_index") == 0))) if without_first_axial else records
    path = F.concat("patient", F.lit("/"), file_name("view", "slab_index", "slabs_total"))
    return r.groupBy("patient").agg(F.lit(budget).alias("image_budget"), F.count("*").alias("n_images"), F.array_sort(F.collect_list(path)).alias("images"))  # a patient's few images


def choose_source(files: DataFrame) -> DataFrame:
    """(folder, patient, file) of each folder's source volume, file null when there is no clear one.

    files: (folder, file). Segmentations never count. Exact names come first: <folder>.nrrd,
    <patient>_brain.nrrd, brain_only.nrrd; then the only file named like a brain volume; then
    the only file at all."""
    patient = F.regexp_replace("folder", "_brain$", "")
    stem = F.regexp_replace("file", r"\.nrrd$", "")
    ok = F.col("file").endswith(".nrrd") & ~F.contains(F.col("file"), F.lit(".seg.")) & ~F.contains(F.lower("file"), F.lit("segmentation"))
    rank = F.when(F.col("file") == F.concat("folder", F.lit(".nrrd")), 1).when(F.col("file") == F.concat(patient, F.lit("_brain.nrrd")), 2).when(F.col("file") == "brain_only.nrrd", 3)
    brain = stem.endswith("_brain") | (stem == "brain_only")
    g = files.withColumn("_ok", ok).groupBy("folder").agg(
        F.min(F.when(F.col("_ok") & rank.isNotNull(), F.struct(rank.alias("r"), F.col("file").alias("f")))).alias("named"),
        F.count_if(F.col("_ok") & brain).alias("nb"), F.min(F.when(F.col("_ok") & brain, F.col("file"))).alias("b"),
        F.count_if("_ok").alias("n"), F.min(F.when(F.col("_ok"), F.col("file"))).alias("o"),
    )
    chosen = F.coalesce(F.col("named.f"), F.when(F.col("nb") == 1, F.col("b")), F.when(F.col("n") == 1, F.col("o")))
    return g.select("folder", patient.alias("patient"), chosen.alias("file"))


def reorient(voxels: DataFrame, order: str = "yxz", flip: str = "") -> DataFrame:
    """Voxels with their axes renamed and flipped: order names, for y, x and z in turn, the axis they
    come from; the new axes in flip run backwards within each patient's volume."""
    if sorted(order) != ["x", "y", "z"] or set(flip) - set("xyz"):
        raise ValueError("order must name each axis once; flip may name axes")
    moved = voxels.select("patient", *[F.col(old).alias(new) for new, old in zip("yxz", order)], "hu")
    if not flip:
        return moved
    top = moved.groupBy("patient").agg(*[F.max(a).alias(f"_{a}") for a in "yxz"])
    return moved.join(top, "patient").select("patient", *[(F.col(f"_{a}") - F.col(a) if a in flip else F.col(a)).alias(a) for a in "yxz"], "hu")


def cut(voxels: DataFrame, box: DataFrame) -> DataFrame:
    """The voxels inside each patient's bounds (any of y0, y1, x0, x1, z0, z1), counted from there on."""
    axes = [a for a in "yxz" if f"{a}0" in box.columns]
    j = voxels.join(box, "patient")
    for a in axes:
        j = j.filter(F.col(a).between(F.col(f"{a}0"), F.col(f"{a}1")))
    return j.select("patient", *[(F.col(a) - F.col(f"{a}0") if a in axes else F.col(a)).alias(a) for a in "yxz"], "hu")


def pipeline(voxels: DataFrame, k: int, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), threshold: float = THRESHOLD, area_frac: float = 0.0, mode: str = "low_clip") -> DataFrame:
    """Projections of the fixed protocol: crop to the foreground, trim slices, filter densities, project.
    Crop and trim look at the unfiltered densities."""
    cropped = cut(voxels, crop_box(voxels, spacing, threshold))
    trimmed = cut(cropped, trim_range(cropped, threshold, area_frac))
    return project(trimmed.withColumn("hu", hu_filter("hu", mode)), k)


def sweep(patients: DataFrame, ks: list[int], done: DataFrame | None = None, only: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """(patient, k) still to be made: every patient with every k, without those in done (patient, k).
    only: names, each possibly a comma list; limit: the first patients by name."""
    p = patients.select("patient").distinct()
    if only:
        names = [n.strip() for x in only for n in x.split(",") if n.strip()]
        p = p.filter(F.col("patient").isin(names))
    if limit is not None:
        p = p.orderBy("patient").limit(limit)
    grid = p.select("patient", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    return grid if done is None else grid.join(done.select("patient", "k"), ["patient", "k"], "left_anti")


def command(script: str, source: Column | str, target: Column | str, k: Column | str, options: dict[str, object] | None = None) -> Column:
    """The generator call of an image set, for the record: options that are false, 0 or None are left
    out, true ones stand as flags."""
    src, out, kk = (F.col(x) if isinstance(x, str) else x for x in (source, target, k))
    parts = [F.lit(script), F.lit("--nrrd_path"), src, F.lit("--out_root"), out, F.lit("--slabs_per_axis"), kk.cast("string")]
    for name, value in (options or {}).items():
        if value is True:
            parts.append(F.lit(f"--{name}"))
        elif value not in (None, False, 0, 0.0):
            parts += [F.lit(f"--{name}"), F.lit(str(value))]
    return F.concat_ws(" ", *parts)


def sweep_plan(grid: DataFrame, files: DataFrame, done: DataFrame | None = None, dry_run: bool = False) -> DataFrame:
    """(patient, k, file, status, error) of every wanted image set: missing (no source file, an error), skip
    (made already), dry_run, or run. files: (patient, file); done: (patient, k)."""
    p = grid.join(files.select("patient", "file"), "patient", "left")
    p = p.withColumn("_done", F.lit(False)) if done is None else p.join(done.select("patient", "k").distinct().withColumn("_done", F.lit(True)), ["patient", "k"], "left")
    none = F.col("file").isNull()
    status = F.when(none, "missing").when(F.coalesce("_done", F.lit(False)), "skip").otherwise("dry_run" if dry_run else "run")
    error = F.when(none, F.format_string("K%d %s: no brain-only NRRD found", "k", "patient"))
    return p.select("patient", "k", "file", status.alias("status"), error.alias("error"))


def outcome(plan: DataFrame, exits: DataFrame | None = None) -> DataFrame:
    """(n_jobs, n_failed, exit_code) of a sweep. exits: (patient, k, code) of the calls that ran; a code
    other than 0 is a failure, as is an error of the plan."""
    p = plan if exits is None else plan.join(exits.select("patient", "k", "code"), ["patient", "k"], "left")
    bad = F.col("error").isNotNull() if exits is None else F.col("error").isNotNull() | (F.coalesce("code", F.lit(0)) != 0)
    return p.agg(F.count("*").alias("n_jobs"), F.count_if(bad).alias("n_failed")).withColumn("exit_code", F.when(F.col("n_failed") > 0, 1).otherwise(0))


def failures(plan: DataFrame, exits: DataFrame) -> DataFrame:
    """(patient, k, message) of every failure of a sweep."""
    p = plan.join(exits.select("patient", "k", "code"), ["patient", "k"], "left")
    message = F.coalesce("error", F.when(F.coalesce("code", F.lit(0)) != 0, F.format_string("K%d %s: exit %d", "k", "patient", "code")))
    return p.select("patient", "k", message.alias("message")).filter("message IS NOT NULL")


def patient_manifest(records: DataFrame, budget: int, orientation: DataFrame | None = None) -> DataFrame:
    """(patient, image_budget, orientation_original, images): one manifest per patient, images being an
    array of struct(file, view, axis, slab_index, slabs_total, extent_mm, extent_frac,
    coverage_band, side) by file; global images have no extent_mm. orientation: (patient, original)."""
    mm = F.when(F.col("mm_lo").isNotNull(), F.array("mm_lo", "mm_hi"))
    image = F.struct(file_name("view", "slab_index", "slabs_total").alias("file"), "view", "axis", "slab_index", "slabs_total", mm.alias("extent_mm"), F.array("frac_lo", "frac_hi").alias("extent_frac"), "coverage_band", "side")
    g = records.groupBy("patient").agg(F.lit(budget).alias("image_budget"), F.array_sort(F.collect_list(image)).alias("images"))  # a patient's few images
    if orientation is None:
        return g.select("patient", "image_budget", F.lit(None).cast("string").alias("orientation_original"), "images")
    return g.join(orientation.select("patient", F.col("original").alias("orientation_original")), "patient", "left").select("patient", "image_budget", "orientation_original", "images")


def write_patient_manifests(manifests: DataFrame, target: str) -> None:
    """<target>/patient=<name>/ with each patient's manifest as JSON, nulls written."""
    manifests.withColumn("protocol", F.struct("image_budget")).withColumn("orientation", F.struct(F.col("orientation_original").alias("original"))).select("patient", "protocol", "orientation", "images").write.option("ignoreNullFields", "false").partitionBy("patient").mode("errorifexists").json(target)


def rollup(manifests: DataFrame) -> DataFrame:
    """(n_patients, patient, image_budget, orientation_original, images, coverage): the data set's manifest,
    a row per patient; images are paths below the root, coverage the records themselves."""
    n = manifests.agg(F.count("*").alias("n_patients"))
    path = F.transform("images", lambda i: F.concat(F.col("patient"), F.lit("/"), i["file"]))
    return manifests.select("patient", "image_budget", "orientation_original", path.alias("paths"), F.col("images").alias("coverage")).join(F.broadcast(n)).select("n_patients", "patient", "image_budget", "orientation_original", F.col("paths").alias("images"), "coverage")  # n is one row


IMAGE = ["patient", "view", "slab_index"]


def pixels(projected: DataFrame, norm: str = "window", bounds: DataFrame | None = None, low: float = 0.01, high: float = 0.995, level: float = LEVEL, width: float = WIDTH, flip: bool = False) -> DataFrame:
    """(patient, view, slab_index, row, col, value): 8-bit images of projections (patient, view, slab_index,
    row, col, hu).

    norm window maps a fixed range; per_volume the range in bounds (patient, lo, hi); per_image
    the percentiles of each image's own foreground, (0, 1) without any. flip turns axial and
    coronal images left to right; a sagittal image shows one side and is never turned."""
    if norm == "window":
        lo, hi, p = *window_bounds(level, width), projected
    elif norm == "per_volume":
        if bounds is None:
            raise ValueError("per_volume needs the bounds of the volumes")
        lo, hi, p = F.col("lo"), F.col("hi"), projected.join(bounds.select("patient", "lo", "hi"), "patient")
    elif norm == "per_image":
        q = projected.groupBy(*IMAGE).agg(F.expr(f"percentile(cast(hu as double), array({low}D, {high}D)) FILTER (WHERE hu > {FLOOR}D)").alias("p"))
        a, b = F.coalesce(F.get("p", F.lit(0)), F.lit(0.0)), F.coalesce(F.get("p", F.lit(1)), F.lit(1.0))
        q = q.select(*IMAGE, a.alias("lo"), F.when(b > a, b).otherwise(a + 1.0).alias("hi"))
        lo, hi, p = F.col("lo"), F.col("hi"), projected.join(q, IMAGE)
    else:
        raise ValueError(f"unknown norm {norm}")
    out = p.select(*IMAGE, "row", "col", to_pixel("hu", lo, hi).alias("value"))
    if not flip:
        return out
    last = out.groupBy(*IMAGE).agg(F.max("col").alias("_last"))
    turned = F.when(F.col("view").endswith("sagittal"), F.col("col")).otherwise(F.col("_last") - F.col("col"))
    return out.join(last, IMAGE).select(*IMAGE, "row", turned.alias("col"), "value")
