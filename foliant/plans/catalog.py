"""Tables of documents, blocks and structured data: reads and changes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The moves between document states that the service makes (fixed values).
MOVES = {"uploaded": ["extracting"], "extracting": ["completed", "failed"], "completed": ["extracting"], "failed": ["extracting"]}
BLOCK_TYPES = ["text", "table", "image", "list", "heading"]


def point(df: DataFrame, key: str, value: object) -> DataFrame:
    """The filter reaches the scan."""
    return df.where(F.col(key) == value).limit(1)


def page_of(df: DataFrame, key: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """In the order of the key; no or zero limit takes all."""
    out = df.orderBy(key)
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit else out


def page_after(df: DataFrame, keys: list[str], after: tuple | None, limit: int) -> DataFrame:
    """The next ``limit`` rows in the order of the keys (null last) behind the row whose keys are ``after``; None is the start.

    The seek is a filter that reaches the scan, and each task keeps ``limit`` rows, so page n costs what page 1 does. The keys
    together must tell rows apart; rows that share all of them stand on one page only if it has room for them.
    """
    if after is not None:
        behind, equal = F.lit(False), F.lit(True)
        for key, value in zip(keys, after, strict=True):
            behind = behind | (equal & ((F.col(key) > value) | F.col(key).isNull()) if value is not None else F.lit(False))
            equal = equal & F.col(key).eqNullSafe(F.lit(value))
        first = keys[0]
        # said of the first key alone as well, since only such a filter is pushed
        df = df.where(behind & ((F.col(first) >= after[0]) | F.col(first).isNull() if after[0] is not None else F.col(first).isNull()))
    return df.orderBy(*(F.asc_nulls_last(k) for k in keys)).limit(limit)


def blocks_of(blocks: DataFrame, content_type: str | None = None, page: int | None = None) -> DataFrame:
    """A type wins over a page; neither takes all."""
    if content_type is not None:
        if content_type not in BLOCK_TYPES:
            raise ValueError(f"content_type must be one of {', '.join(BLOCK_TYPES)}")
        return blocks.where(F.col("kind") == content_type)
    return blocks if page is None else blocks.where(F.col("page") == page)


def bucket(kind: Column) -> Column:
    """P10: lists fall in no bucket."""
    return F.when(kind.isin("text", "heading"), "text_blocks").when(kind == "table", "tables").when(kind == "image", "images")


def iso(ts: Column) -> Column:
    """ISO form; the fraction only where there is one."""
    return F.when(F.date_format(ts, "SSSSSS") == "000000", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def _safe(key: str, old: DataFrame, new: DataFrame) -> Column:
    return old[key].eqNullSafe(new["_key"])


def replace(old: DataFrame, new: DataFrame, key: str, redone: DataFrame | None = None) -> DataFrame:
    """T4: rows of ``old`` whose key is in ``redone`` (else in ``new``) go, all rows of ``new`` come; null is a key like any other."""
    keys = (new if redone is None else redone).select(F.col(key).alias("_key")).distinct()
    return old.join(keys, _safe(key, old, keys), "left_anti").unionByName(new)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """One row a key of ``new`` replaces those with the same key; null is a key like any other.

    Of rows in ``new`` that share a key the last in the order of their columns stays, so a rerun changes nothing.
    """
    rest = [c for c in new.columns if c != key]
    once = new.groupBy(key).agg(F.max(F.struct(*rest)).alias("v")).select(*(key if c == key else f"v.{c}" for c in new.columns)) if rest else new.distinct()
    return replace(old, once, key)


def delete(old: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """C3."""
    return old.join(keys.select(key), key, "left_anti")


#: Folders into which a stored table of blocks is cut; a table keeps the number it was begun with.
BUCKETS = 64


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def reextract(new: DataFrame, redone: DataFrame, folder: str, key: str, buckets: int = BUCKETS) -> None:
    """Put a run's blocks into a stored table in the place of all blocks of the documents it has done again.

    The table is cut into buckets by document. Only buckets of documents in ``redone`` are read, and only those are
    overwritten, when all of them are written; a document that now has fewer blocks, or none, leaves none behind, and a rerun gives the same table.
    """
    spark = new.sparkSession
    mine = [r[0] for r in redone.select(_bucket(key, buckets)).distinct().collect()]  # at most ``buckets``
    rows = new.withColumn("bucket", _bucket(key, buckets))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.exists(path):
        old = spark.read.schema(rows.schema).parquet(folder).where(F.col("bucket").isin(mine))
        keys = redone.select(F.col(key).alias("_key")).distinct()
        rows = old.join(keys, _safe(key, old, keys), "left_anti").unionByName(rows)
    # a bucket that loses all its rows isn't written, so it goes by itself once the others are in place
    staged = f"{folder}.staged-{uuid.uuid4().hex}"
    rows.repartition("bucket").write.partitionBy("bucket").parquet(staged)
    left = spark.read.schema(rows.schema).parquet(staged)
    left.repartition("bucket").write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)
    full = {r[0] for r in left.select("bucket").distinct().collect()}
    for bucket in set(mine) - full:
        store.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/bucket={bucket}"), True)
    store.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged), True)


def transitions(events: DataFrame, by: str, order: list, state: str) -> DataFrame:
    """Each state with the one before it, and whether the move is allowed."""
    before = F.lag(state).over(Window.partitionBy(by).orderBy(*order))
    legal = [(before == a) & F.col(state).isin(b) for a, b in MOVES.items()]
    ok = before.isNull()
    for test in legal:
        ok = ok | F.coalesce(test, F.lit(False))
    return events.withColumns({"before": before, "allowed": ok})


def to_json(data: Column) -> Column:
    """Pretty, characters beyond ASCII kept."""
    return F.to_json(data, {"pretty": "true"})


def response(blocks: DataFrame, entities: str = "entities", metadata: str = "metadata") -> DataFrame:
    """Entities (array) and metadata (text of a JSON object) as a reader expects them: never null, and anything but an object is an empty one."""
    kind = blocks.schema[entities].dataType.simpleString()
    parsed = F.when(F.trim(metadata).startswith("{"), F.from_json(metadata, "map<string,string>"))
    return blocks.withColumns({entities: F.coalesce(entities, F.array().cast(kind)), metadata: F.coalesce(parsed, F.create_map().cast("map<string,string>"))})


def stored(text: Column) -> Column:
    """JSON text, parsed once, as a variant that keeps the types of its values; null where it is malformed."""
    return F.try_parse_json(text)


def at(data: Column, path: str, kind: str = "string") -> Column:
    """What stands at a path such as ``$.page_number``; null where nothing does, or nothing of that type."""
    return F.try_variant_get(data, path, kind)


def on_page(blocks: DataFrame, page: str, metadata: str = "metadata") -> DataFrame:
    """Blocks (metadata: a variant) of a page, compared as text, so that 2 and "2" are one page."""
    return blocks.where(at(F.col(metadata), "$.page_number") == page)


def is_object(data: Column) -> Column:
    return F.coalesce(F.schema_of_variant(data).startswith("OBJECT"), F.lit(False))


def described(data: Column, fields: dict[str, str]) -> Column:
    """A struct of typed fields of a stored object; of anything but an object all of them are null."""
    return F.struct(*(F.when(is_object(data), at(data, f"$.{name}", kind)).alias(name) for name, kind in fields.items()))


def statistics_of(structured: DataFrame, doc: str, data: str = "data", names: tuple[str, ...] = ("total_blocks", "total_entities", "total_pages")) -> DataFrame:
    """Numbers below ``statistics`` of a JSON text; null where they are missing."""
    return structured.select(doc, *(at(stored(F.col(data)), f"$.statistics.{n}", "long").alias(n) for n in names))


def status_of(docs: DataFrame, doc: str) -> DataFrame:
    """P14."""
    return docs.select(doc, "status", "filename", "created_at", "updated_at")


def completed(docs: DataFrame) -> DataFrame:
    """What may be rendered."""
    return docs.where("status = 'completed'")


def uploaded(files: DataFrame) -> DataFrame:
    """Files (path, filename, length, mime, modificationTime) as rows of the documents table; the same place has the same id."""
    meta = F.create_map(F.lit("filename"), F.col("filename"), F.lit("mime_type"), F.col("mime"), F.lit("size"), F.col("length").cast("string"))
    at = F.col("modificationTime")
    return files.select(F.sha2("path", 256).alias("id"), "filename", F.col("mime").alias("file_type"), F.col("length").alias("file_size"), F.lit("uploaded").alias("status"), meta.alias("metadata"), at.alias("created_at"), at.alias("updated_at"))


def persisted(related: DataFrame, doc: str) -> DataFrame:
    """Blocks as stored rows, with their neighbours' and parents' real ids."""
    return related.select("id", F.col(doc).alias("document_id"), F.col("kind").alias("type"), "content", "page", "ord", "entities", "relevance", F.col("prev_id").alias("previous_block_id"), F.col("next_id").alias("next_block_id"), F.col("parent_id").alias("parent_block_id"))


def with_status(docs: DataFrame, status: str) -> DataFrame:
    """Documents of a status; the filter reaches the scan."""
    if status not in MOVES:
        raise ValueError(f"status must be one of {', '.join(MOVES)}")
    return docs.where(F.col("status") == status)


def having(docs: DataFrame, blocks: DataFrame, doc: str, kind: str | None = None) -> DataFrame:
    """Documents that have blocks (of a kind)."""
    return docs.join(blocks if kind is None else blocks.where(F.col("kind") == kind), doc, "left_semi")


def lacking(docs: DataFrame, blocks: DataFrame, doc: str, kind: str | None = None) -> DataFrame:
    """Documents that have no blocks (of a kind)."""
    return docs.join(blocks if kind is None else blocks.where(F.col("kind") == kind), doc, "left_anti")


def data_of(docs: DataFrame, structured: DataFrame, blocks: DataFrame, doc: str, content: list[str], about: list[str]) -> DataFrame:
    """Each document with its structured data and its blocks in three lists (texts and headings, tables, images), each in the order of its places.

    blocks: doc, kind, page, ord, nth and the columns of ``content``; a document without blocks has empty lists, one without data nulls in ``about``. Blocks move once.
    """
    entry = F.struct(*(x.alias(f"o{i}") for i, x in enumerate([F.coalesce(F.col("ord"), F.lit(0)), F.coalesce(F.col("page"), F.lit(0)), F.col("nth")])), *content)
    names = ("text_blocks", "tables", "images")
    lists = blocks.withColumn("_bucket", bucket(F.col("kind"))).groupBy(doc).agg(*(F.array_sort(F.collect_list(F.when(F.col("_bucket") == n, entry))).alias(n) for n in names))
    lists = lists.select(doc, *(F.transform(n, lambda x: F.struct(*(x[c].alias(c) for c in content))).alias(n) for n in names))
    kind = lists.schema["text_blocks"].dataType.simpleString()
    joined = docs.join(lists, doc, "left").join(structured.select(doc, *about), doc, "left")
    return joined.withColumns({n: F.coalesce(n, F.array().cast(kind)) for n in names})


def partitioned_source(spark: SparkSession, url: str, name: str, column: str, parts: int, **options: str) -> DataFrame:
    """A table of a relational database, read in ``parts`` ranges of a numeric column; filters and columns are pushed to it."""
    read = lambda **own: spark.read.format("jdbc").options(url=url, **options, **own).load()
    least, most = read(query=f"SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {name}").first()
    if least is None or least == most:
        return read(dbtable=name)
    return read(dbtable=name, partitionColumn=column, lowerBound=str(least), upperBound=str(most), numPartitions=str(parts))


def merge_into(new: DataFrame, url: str, name: str, key: str, parts: int = 8, **options: str) -> None:
    """Put rows into a relational table, one a key, so that a write which runs again changes nothing.

    Tasks write to a table of their own; one statement each then takes the old rows of its keys out and the new ones in, in one transaction of the database.
    """
    spark = new.sparkSession
    columns = new.columns
    once = new.groupBy(key).agg(F.max(F.struct(*[c for c in columns if c != key])).alias("v")).select(*(key if c == key else f"v.{c}" for c in columns))
    staged = f"{name}_staged_{uuid.uuid4().hex[:12]}"
    once.where(F.col(key).isNotNull()).repartition(parts, key).write.format("jdbc").options(url=url, dbtable=staged, **options).mode("overwrite").save()
    link = spark.sparkContext._jvm.java.sql.DriverManager.getConnection(url)
    quoted = lambda c: f'"{c}"'
    try:
        link.setAutoCommit(False)
        run = link.createStatement()
        run.executeUpdate(f"DELETE FROM {name} WHERE {quoted(key)} IN (SELECT {quoted(key)} FROM {staged})")
        run.executeUpdate(f"INSERT INTO {name} ({', '.join(map(quoted, columns))}) SELECT {', '.join(map(quoted, columns))} FROM {staged}")
        run.executeUpdate(f"DROP TABLE {staged}")
        link.commit()
    except Exception:
        link.rollback()
        raise
    finally:
        link.close()


def save(df: DataFrame, folder: str, name: str, by: str | None = None, mode: str = "overwrite") -> str:
    """A table as Parquet; returns its path. ``by`` partitions it."""
    path = f"{folder.rstrip('/')}/{name}"
    (df.write.partitionBy(by) if by else df.write).mode(mode).parquet(path)
    return path


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}")
