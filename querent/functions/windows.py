"""Page windows and reading order as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sliding(pages: Column, size: int, stride: int | None = None) -> Column:
    """array of windows of `size` consecutive pages; the stride is half the size unless given (1 for size 1).

    A last window that would be short is replaced by the last `size` pages; fewer pages than that are one window.
    """
    step = 1 if size <= 1 else (stride or max(1, size // 2))
    n = F.size(pages)
    last = F.ceil((n - size) / F.lit(step)).cast("int")
    reach = F.least(last, F.floor((n - 1) / F.lit(step)).cast("int"))
    many = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(reach, F.lit(0))), lambda i: F.least(i * step, n - size)))
    return F.when(n == 0, F.array().cast("array<int>")).when(n <= size, F.array(F.lit(0))).otherwise(many)


def sliding_windows(pages: Column, size: int, stride: int | None = None) -> Column:
    return F.transform(sliding(pages, size, stride), lambda s: F.slice(pages, s + 1, size))


def tumbling_windows(pages: Column, size: int) -> Column:
    """Consecutive windows; a short last one is kept."""
    starts = F.when(F.size(pages) > 0, F.sequence(F.lit(1), F.size(pages), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.slice(pages, s, size))


def anchor_window(pages: Column, answer_page: Column, size: int) -> Column:
    """The window around the answer's page (the first page if it is unknown), inside the document."""
    anchor = F.greatest(F.coalesce(F.array_position(pages, answer_page), F.lit(1)).cast("int") - 1, F.lit(0))
    start = F.greatest(F.lit(0), F.least(anchor - size // 2, F.size(pages) - size))
    return F.slice(pages, start + 1, size)


def reading_order(objects: Column) -> Column:
    """Texts of layout objects (BBOX, OCR) by top, left, then text, a line each."""
    rows = F.transform(F.filter(objects, lambda o: o["OCR"].isNotNull() & (F.size(o["BBOX"]) >= 2)), lambda o: F.struct(o["BBOX"][1].alias("y"), o["BBOX"][0].alias("x"), o["OCR"].alias("text")))
    return F.array_join(F.transform(F.array_sort(rows), lambda r: r["text"]), "\n")


def verifier_order(objects: Column) -> Column:
    """Texts by top alone, ties in the objects' order; blank texts are left out."""
    kept = F.transform(objects, lambda o, i: F.struct(F.get(o["BBOX"], F.lit(1)).alias("y"), i.alias("i"), F.trim(o["OCR"]).alias("text")))
    return F.array_join(F.transform(F.array_sort(F.filter(kept, lambda r: F.coalesce(r["text"], F.lit("")) != "")), lambda r: r["text"]), "\n")


def numbered_images(turns: Column, window: Column) -> Column:
    """All image paths, those of example turns first, with one running number."""
    every = F.concat(F.flatten(F.transform(turns, lambda t: F.coalesce(t["image_paths"], F.array().cast("array<string>")))), window)
    return F.transform(every, lambda p, i: F.struct((i + 1).alias("number"), p.alias("path")))


def page_texts(pages: Column) -> Column:
    """map<path, text> of pages (path, objects) in reading order; pages without text are left out."""
    read = F.transform(pages, lambda p: F.struct(p["path"].alias("key"), reading_order(p["objects"]).alias("value")))
    return F.map_from_entries(F.filter(read, lambda e: F.trim(e["value"]) != ""))


def numbered_texts(document: Column, window: Column, texts: Column) -> Column:
    """The texts of a window's pages, each under its number in the document; pages without text are left out."""
    named = F.transform(window, lambda p: F.concat(F.lit("Page "), F.array_position(document, p).cast("string"), F.lit(":\n"), F.try_element_at(texts, p)))
    return F.array_join(F.filter(named, lambda x: x.isNotNull()), "\n\n")
