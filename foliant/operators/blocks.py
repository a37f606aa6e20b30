"""Content blocks: order, links, sections, indexes, statistics, merges, attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import truthy

BEFORE = (Window.unboundedPreceding, Window.currentRow)


#: Added to the places of texts that are read from images: they stand behind all of a document's own texts.
APPENDED = 1 << 40


def kind_rank(kind: Column) -> Column:
    """Among blocks of one order and page texts and headings come first, then tables, then images."""
    return F.when(kind == "image", 2).when(kind == "table", 1).otherwise(0)


def place(kind: str = "kind", page: str = "page", order: str = "ord", nth: str = "nth") -> list[Column]:
    """The one order of mixed blocks: order, page or 0, kind, place in the list of the kind."""
    return [F.coalesce(F.col(order), F.lit(0)), F.coalesce(F.col(page), F.lit(0)), kind_rank(F.col(kind)), F.col(nth)]


def append_read(texts: DataFrame, read: DataFrame, nth: str = "nth") -> DataFrame:
    """A document's own texts, then those read from its images, each in their own order; no text is counted or moved for that."""
    own = texts.withColumns({nth: F.col(nth).cast("long"), "appended": F.lit(False)})
    return own.unionByName(read.withColumns({nth: F.col(nth).cast("long") + F.lit(APPENDED), "appended": F.lit(True)}))


def block_kind(section_level: Column) -> Column:
    """P19."""
    return F.when(truthy(section_level) & (section_level <= 3), "heading").otherwise("text")


def block_id(doc: str, *parts: str) -> Column:
    """The same id for the same place, so retries agree."""
    return F.concat_ws(":", F.col(doc), *parts)


def link(blocks: DataFrame, doc: str, order: list | None = None, id_: str = "id") -> DataFrame:
    """Neighbours in the order, that of mixed blocks unless another is given; one shuffle by document."""
    w = Window.partitionBy(doc).orderBy(*(order or place()))
    return blocks.withColumns({"prev_id": F.lag(id_).over(w), "next_id": F.lead(id_).over(w)})


def running_ordinal(blocks: DataFrame, by: list[str], order: list, out: str = "ordinal") -> DataFrame:
    """W7."""
    return blocks.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def fill_title(blocks: DataFrame, doc: str, order: list, heading: Column, title: str, out: str = "section_title") -> DataFrame:
    """The last heading at or before each block."""
    w = Window.partitionBy(doc).orderBy(*order).rowsBetween(*BEFORE)
    return blocks.withColumn(out, F.last(F.when(heading, F.col(title)), ignorenulls=True).over(w))


def number_sections(blocks: DataFrame, doc: str, order: list, heading: Column) -> DataFrame:
    """section_no counts headings so far; 0 holds the orphans."""
    w = Window.partitionBy(doc).orderBy(*order).rowsBetween(*BEFORE)
    return blocks.withColumn("section_no", F.sum(heading.cast("int")).over(w))


def sections(numbered: DataFrame, doc: str, order: str, heading: Column, title: str, id_: str = "id") -> DataFrame:
    """One row per section or orphan group, its ids in order; shares the shuffle of the numbering."""
    ids = F.array_sort(F.collect_list(F.struct(order, id_)))
    grouped = numbered.groupBy(doc, "section_no").agg(ids.alias("b"), F.max(F.when(heading, F.col(title))).alias("title"))
    return grouped.select(doc, "section_no", "title", F.transform("b", lambda x: x[id_]).alias("block_ids"))


def inverted_index(blocks: DataFrame, doc: str, key: str, order: str, id_: str = "id") -> DataFrame:
    """A1-A3: (doc, key, ids in order); ids repeat as often as a key does; empty labels and page 0 are no keys."""
    filled = F.col(key) != "" if blocks.schema[key].dataType.simpleString() == "string" else truthy(F.col(key))
    made = blocks.where(filled).groupBy(doc, key).agg(F.array_sort(F.collect_list(F.struct(order, id_))).alias("b"))
    return made.select(doc, key, F.transform("b", lambda x: x[id_]).alias("ids"))


def statistics(blocks: DataFrame, doc: str) -> DataFrame:
    """Blocks, kinds, entities and truthy pages of a document; blocks has kind, page and n_entities."""
    return blocks.groupBy(doc).agg(
        F.count("*").alias("total_blocks"),
        *(F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in ("text", "heading", "table", "image")),
        F.sum(F.col("n_entities").cast("long")).alias("total_entities"),
        F.countDistinct(F.when(truthy(F.col("page")), F.col("page"))).alias("total_pages"),
    )


def content_summary(blocks: DataFrame, doc: str) -> DataFrame:
    """How many texts (headings among them), tables and images a document has, and whether it has content at all."""
    kind = F.col("kind")
    some = {"n_text": kind.isin("text", "heading"), "n_tables": kind == "table", "n_images": kind == "image"}
    return blocks.groupBy(doc).agg(*(F.count(F.when(c, 1)).alias(n) for n, c in some.items()), (F.count(F.when(kind.isin("text", "heading", "table", "image"), 1)) > 0).alias("has_content"))


def union_contents(texts: DataFrame, tables: DataFrame, images: DataFrame, doc: str) -> DataFrame:
    """One block schema for all three kinds; each has doc, ord and page, and nth where its place in its list isn't ord.

    texts: text, section_level, entities, confidence. tables: headers, rows. images: image_path, ocr_text, metadata.
    Content is a struct in which only the fields of the kind are filled; an image's bytes stay behind.
    """
    place = lambda df: [F.col(doc), F.col("ord").cast("int").alias("ord"), F.col("page").cast("int").alias("page"), F.col("nth" if "nth" in df.columns else "ord").cast("long").alias("nth")]
    fields = {"text": "string", "headers": "array<string>", "rows": "array<array<string>>", "image_path": "string", "ocr_text": "string", "metadata": "map<string,string>"}
    filled = lambda *names: F.struct(*((F.col(n) if n in names else F.lit(None)).cast(t).alias(n) for n, t in fields.items())).alias("content")
    none = [F.array().cast("array<string>").alias("entities"), F.lit(None).cast("double").alias("relevance")]
    made = texts.select(*place(texts), block_kind(F.col("section_level")).alias("kind"), filled("text"), F.coalesce("entities", F.array().cast("array<string>")).alias("entities"), F.col("confidence").cast("double").alias("relevance"))
    return made.unionByName(tables.select(*place(tables), F.lit("table").alias("kind"), filled("headers", "rows"), *none)).unionByName(images.select(*place(images), F.lit("image").alias("kind"), filled("image_path", "ocr_text", "metadata"), *none))


def relate(blocks: DataFrame, doc: str, order: list | None, seq: str | Column, title: str, heading: Column, id_: str = "id") -> DataFrame:
    """Neighbours and parents together."""
    return attach_parents(link(blocks, doc, order, id_), doc, seq, title, heading, id_)


def merge_sources(first: DataFrame, second: DataFrame, doc: str, page: str = "page", seq: str = "ord") -> DataFrame:
    """Per page the first block of ``second``, else of ``first``; blocks without a page go. nth is a block's place in the merged list."""
    both = first.withColumn("source_rank", F.lit(1)).unionByName(second.withColumn("source_rank", F.lit(0))).where(truthy(F.col(page)))
    w = Window.partitionBy(doc).orderBy(page, "source_rank", seq)  # the second window reads the first one's rows as they lie
    kept = both.withColumn("before", F.lag(page).over(w)).where(~F.col("before").eqNullSafe(F.col(page))).drop("before")
    return kept.withColumn("nth", F.row_number().over(w).cast("long") - 1)


def merge_results(first: DataFrame, second: DataFrame, doc: str) -> DataFrame:
    """Two readings of the same documents as one: texts by page (J1), tables of ``first``, images and structure of ``second``, metadata of both.

    Both are streams of blocks with kind, page, ord, nth and properties; the kind "properties" carries a document's metadata,
    "structure" its outline. One shuffle by document.
    """
    both = first.withColumn("source_rank", F.lit(1)).unionByName(second.withColumn("source_rank", F.lit(0)))
    kind, texts = F.col("kind"), F.col("kind").isin("text", "heading")
    both = both.where((texts & truthy(F.col("page"))) | ((kind == "table") & (F.col("source_rank") == 1)) | (kind.isin("image", "structure") & (F.col("source_rank") == 0)) | (kind == "properties"))
    group = F.when(texts, "text").otherwise(kind)
    w = Window.partitionBy(doc).orderBy(group, F.when(texts, F.col("page")), "source_rank", "nth")
    same = F.lag(F.struct(group, "page")).over(w).eqNullSafe(F.struct(group, F.col("page")))
    none = F.create_map().cast("map<string,string>")
    # properties stand in the order of their source: the second reading's come first, so those after it only fill gaps
    met = F.aggregate(F.collect_list(F.when(kind == "properties", F.coalesce("properties", none))).over(w), none, lambda low, high: merge_maps(high, low))
    last = ~F.lead(group).over(w).eqNullSafe(group)
    marked = both.withColumns({"_same": F.coalesce(same, F.lit(False)), "_met": met, "_last": last})
    kept = marked.where((texts & ~F.col("_same")) | kind.isin("table", "image", "structure") | ((kind == "properties") & F.col("_last")))
    return kept.withColumn("properties", F.when(kind == "properties", F.col("_met")).otherwise(F.col("properties"))).drop("_same", "_met", "_last")


def merge_maps(low: Column, high: Column) -> Column:
    """Entries of both maps; those of ``high`` win."""
    extra = F.map_filter(low, lambda k, v: ~F.array_contains(F.map_keys(high), k))
    return F.map_concat(extra, high)


def attach_parents(blocks: DataFrame, doc: str, seq: str | Column, title: str, heading: Column, id_: str = "id") -> DataFrame:
    """The first heading with the same title, null-safe."""
    heads = blocks.where(heading).groupBy(F.col(doc).alias("_d"), F.col(title).alias("_t")).agg(F.min_by(id_, seq).alias("parent_id"))
    return blocks.join(heads, (F.col(doc) == F.col("_d")) & F.col(title).eqNullSafe(F.col("_t")), "left").drop("_d", "_t")


def attempts(images: DataFrame) -> DataFrame:
    """Every image with 3 preprocessing methods times 4 segmentation modes, numbered from 0."""
    plans = [(m, p) for m in ("advanced", "aggressive", "basic") for p in (6, 11, 3, 12)]
    return images.withColumn("a", F.explode(F.array(*(F.struct(F.lit(i).alias("attempt"), F.lit(m).alias("preprocess"), F.lit(p).alias("psm")) for i, (m, p) in enumerate(plans))))).select("*", "a.*").drop("a")


def mean_confidence(confidences: Column) -> Column:
    """Mean of an array without the sentinel -1, in hundredths; 0 where nothing is left."""
    good = F.filter(confidences, lambda x: x != -1)
    return F.when(F.size(good) > 0, F.aggregate(good, F.lit(0.0), lambda s, x: s + x) / F.size(good) / 100).otherwise(0.0)


def best_attempt(tries: DataFrame, by: str) -> DataFrame:
    """The highest confidence, then the longest text, then the earliest attempt; combined before the shuffle."""
    order = F.struct(F.col("confidence"), F.length("text"), -F.col("attempt"))
    return tries.groupBy(by).agg(F.max_by(F.struct("attempt", "confidence", "text"), order).alias("b")).select(by, "b.*")
