"""Names of runs, conditions and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of modes in labels.
MODE_LABELS = {"zeroshot": "Zero-Shot", "fewshot": "Few-Shot", "finetuned": "Fine-Tuned (LoRA)"}


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def derive_mode(finetuned: Column, few_shot: Column) -> Column:
    return F.when(finetuned, "finetuned").when(few_shot, "fewshot").otherwise("zeroshot")


def slug(mode: Column, ocr: Column, window: Column, few_shot: Column | None = None) -> Column:
    """mode_ocr[_wN][_kN_type_selection]; few_shot: struct<enabled, n_shots, shot_type, selection>."""
    out = F.concat(mode, F.when(ocr, "_ocr").otherwise("_noocr"), F.when(F.coalesce(window, F.lit(0)).isin(0, 1), "").otherwise(F.concat(F.lit("_w"), window.cast("string"))))
    if few_shot is None:
        return out
    shots = F.concat_ws("_", F.concat(F.lit("_k"), F.coalesce(few_shot["n_shots"], F.lit(0)).cast("string")), F.coalesce(few_shot["shot_type"], F.lit("mixed")), F.coalesce(few_shot["selection"], F.lit("random")))
    return F.concat(out, F.when((mode == "fewshot") & F.coalesce(few_shot["enabled"], F.lit(False)), shots).otherwise(""))


def label(config: Column, ocr: Column, window: Column, few_shot: Column) -> Column:
    """A condition's name for people, its parts joined by middle dots."""
    mode = F.split_part(F.coalesce(config, F.lit("")), F.lit("_"), F.lit(1))
    named = F.when(mode == "", "?").otherwise(mode)
    for key, text in MODE_LABELS.items():
        named = F.when(mode == key, text).otherwise(named)
    width = F.when(~F.coalesce(window, F.lit(1)).isin(0, 1), F.concat(F.lit("w"), window.cast("string")))
    shots = F.when((mode == "fewshot") & F.coalesce(few_shot["enabled"], F.lit(False)), F.concat(F.lit("k"), F.coalesce(few_shot["n_shots"], F.lit(0)).cast("string"), F.lit("-"), F.coalesce(few_shot["selection"], F.lit("random"))))
    return F.concat_ws(" · ", named, F.when(F.coalesce(ocr, F.lit(False)), "OCR").otherwise("no-OCR"), width, shots)


def run_id(split: Column, n: Column, when: Column) -> Column:
    return F.concat_ws("_", F.lit("eval"), split, n.cast("string"), F.date_format(when, "yyyyMMdd_HHmmss"))


def parse_slug(text: Column) -> Column:
    """struct<k, selection> of a few-shot slug; nulls for others."""
    k = F.regexp_extract(text, r"_k([0-9]+)_[a-z]+_([a-z]+)", 1)
    return F.struct(F.nullif(k, F.lit("")).cast("int").alias("k"), F.nullif(F.regexp_extract(text, r"_k([0-9]+)_[a-z]+_([a-z]+)", 2), F.lit("")).alias("selection"))


def strategy(text: Column) -> Column:
    """The mode that a slug begins with, or the slug itself."""
    out = text
    for mode in MODE_LABELS:
        out = F.when(F.startswith(text, F.lit(mode)), mode).otherwise(out)
    return out


def image_path(path: Column, base: str) -> Column:
    """Only paths that begin with ./ are rewritten."""
    return F.when(F.startswith(path, F.lit("./")), F.concat(F.lit(base.rstrip("/") + "/"), F.substring(path, F.lit(3), F.length(path)))).otherwise(path)


def split_name(text: Column) -> Column:
    return F.substring_index(text, "_", 1)


def leaf(run: Column, dataset: Column, slug_: Column, model: Column | None = None) -> Column:
    name = slug_ if model is None else F.when(F.coalesce(model, F.lit("")) == "", slug_).otherwise(F.concat_ws("__", model, slug_))
    return F.concat_ws("/", run, dataset, name)


def iso_utc(when: Column) -> Column:
    return F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def resolve_leaf(root: str, dataset: str, slug_: str, split: str, n: int, stamp: str, environment: dict[str, str], model: str = "", variable: str = "RUN_ID") -> str:
    """The folder of a condition: a run id from the environment wins over a new one."""
    run = environment.get(variable) or f"eval_{split}_{n}_{stamp}"
    return f"{root.rstrip('/')}/{run}/{dataset}/" + (f"{model}__{slug_}" if model else slug_)


def conditions(datasets: list[str], random_shots: tuple[int, ...] = (2,), picked_shots: tuple[int, ...] = (2, 4, 6)) -> list[dict]:
    """The grid of a sweep over the number of examples: random and hand-picked ones for each dataset."""
    kinds = [("random", k) for k in random_shots] + [("handpicked", k) for k in picked_shots]
    return [{"dataset": d, "few_shot": {"enabled": True, "n_shots": k, "shot_type": "mixed", "selection": s}} for d in datasets for s, k in kinds]


def git_state(folder: str) -> tuple[str, bool]:
    """(commit, changed) of a checkout; unknown and unchanged where there is none."""
    import subprocess

    try:
        run = lambda *a: subprocess.check_output(["git", "-C", folder, *a], text=True, stderr=subprocess.DEVNULL).strip()
        return run("rev-parse", "--short", "HEAD"), bool(run("status", "--porcelain"))
    except (OSError, subprocess.CalledProcessError):
        return "unknown", False
