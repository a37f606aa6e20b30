"""Best-fit packing of token pieces into fixed-length sequences by bin completion.

Documents are tokenised in tasks; only (document, piece, length, checksum) rows leave them. How
pieces fill sequences depends on their lengths alone, so the packing is solved on the histogram of
lengths: at most ``MAX_TOKENS`` rows, whatever the corpus. Bin completion takes the longest length
left, enumerates by branch and bound the undominated fillings of the space beside it, prunes by the
waste still reachable (exactly known from the sums that the shorter pieces can make), with the best-fit
filling as first incumbent, and uses the winner as often as the counts allow. Pieces then find their place by their rank within their length.

Ranks come from salted counts (length and a hash bucket of the document), so a length that a third
of all pieces share is ranked by many tasks.

Defined results: null text counts as empty (one piece, the closing id 0); repeated rows are pieces
of their own; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from .common import map_arrow, materialize, shuffle_partitions, with_offsets

MAX_TOKENS = 2048
TOKENIZER = "word_bpe_49k.json"
#: Words and runs whose ids a worker keeps in each of two generations, to bound its memory.
CACHE_WORDS, CACHE_RUNS = 100_000, 300_000

_workers: dict[str, "_Ids"] = {}


class _Recent(dict):
    """A cache of two generations: when the young one is full it becomes the old one, so what is in use stays."""

    def __init__(self, most: int, make):
        self.most, self.make, self.old = most, make, {}

    def __missing__(self, key: str) -> bytes:
        made = self.old.get(key)
        if made is None:
            made = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = made
        return made


def _latin() -> tuple[re.Pattern, bytes]:
    """The tokenizer's own split into runs, for characters below U+0100 that are neither controls nor odd spaces; and all those."""
    kinds: dict[str, str] = {"L": "", "N": "", "": ""}
    for c in map(chr, range(33, 256)):
        kind = unicodedata.category(c)[0]
        if kind not in "CZ":
            kinds[kind if kind in "LN" else ""] += c
    letters, digits, rest = map(re.escape, kinds.values())
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[{rest}]+"), "".join([" \n", *kinds.values()]).encode("latin-1")


class _Ids:
    """Texts to the bytes of their ids.

    The tokenizer lower-cases, drops white space, splits words into runs of letters, single digits and
    runs of other marks, and merges within runs only. So Latin texts are put together from their runs,
    most of which recur. Lines, and in them words, with other characters or with what may be a
    special token are encoded by the tokenizer itself.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.bytes = self.tokenizer.model, ByteLevel(add_prefix_space=False, use_regex=False)
        self.split, self.plain = _latin()
        self.runs, self.words = _Recent(CACHE_RUNS, self.encode_run), _Recent(CACHE_WORDS, self.encode_word)

    def encode_run(self, run: str) -> bytes:
        mapped = run if run.isascii() else self.bytes.pre_tokenize_str(run)[0][0]
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def encode_word(self, word: str) -> bytes:
        if self.is_plain(word):
            return self(word)
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def is_plain(self, text: str) -> bool:
        try:
            return "<|" not in text and not text.encode("latin-1").translate(None, self.plain)
        except UnicodeEncodeError:
            return False

    def __call__(self, text: str) -> bytes:
        if self.is_plain(text):
            return b"".join(map(self.runs.__getitem__, self.split.findall(text.lower())))
        lines = text.split("\n")
        return b"".join(map(self, lines) if len(lines) > 1 else map(self.words.__getitem__, text.split(" ")))


def _pieces(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path not in _workers:
            _workers[path] = _Ids(path)
        encode = _workers[path]
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for r, text in enumerate(batch.column(1)):
                ids = encode(text.as_py() or "") + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at : at + 4 * limit]
                    rows.append(r)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.record_batch(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc", "piece", "start", "length", "crc"],
            )

    return run


def token_pieces(docs: DataFrame, doc: str = "doc_id", text: str = "text", path: str | None = None, limit: int = MAX_TOKENS) -> DataFrame:
    own = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    kind = own.schema["doc"].dataType.simpleString()
    return map_arrow(own, _pieces(path or public_tokenizers.path(TOKENIZER), limit), f"doc {kind}, piece int, start long, length long, crc long")


def _reachable(space: int, order: list[int], counts: dict[int, int]) -> list[int]:
    """For each i, the sums up to ``space`` that pieces of order[i:] can make, as the bits of an integer."""
    mask, sums = (1 << space + 1) - 1, [1]
    for x in reversed(order):
        bits, copies, step = sums[-1], min(counts[x], space // x), 1
        while copies:
            step = min(step, copies)
            bits |= bits << x * step & mask
            copies, step = copies - step, 2 * step
        sums.append(bits)
    return sums[::-1]


def _filling(space: int, lengths: list[int], counts: dict[int, int]) -> list[int]:
    """The undominated filling of ``space`` that wastes least; of several, the one with the longest pieces first.

    A filling dominates another if the other's pieces fit, in groups, into its own. Branches are entered
    in falling lexicographic order and only if they can waste less than the incumbent, at first the best fit: so no filling that
    is kept is dominated by one that comes later, as a dominating one makes the same sum by merging pieces, and that puts it before.
    """
    order = [x for x in lengths if x <= space and counts[x]]
    best: list[int] = []
    left = space
    for x in order:  # the incumbent: best fit takes the longest piece that still fits
        take = min(counts[x], left // x)
        best += [x] * take
        left -= take * x
        if not left:
            return best
    # branch and bound: the sums that the pieces from order[i] on can make tell exactly how much a branch has to waste
    sums, waste = _reachable(space, order, counts), left
    todo: list[tuple[int, int, tuple | None]] = [(0, space, None)]  # next length, space left, pieces chosen as (length, times, those before)
    while todo and waste:
        i, room, chosen = todo.pop()
        if room - ((sums[i] & (2 << room) - 1).bit_length() - 1) >= waste:
            continue
        if i == len(order):  # no branch after this one wastes less unless its bound says so
            waste, best = room, []
            while chosen:
                x, take, chosen = chosen
                best = [x] * take + best
            continue
        x = order[i]
        # the filling with most of the longest piece comes first
        todo += [(i + 1, room - take * x, (x, take, chosen) if take else chosen) for take in range(min(counts[x], room // x) + 1)]
    return best


def complete_bins(histogram: dict[int, int], limit: int = MAX_TOKENS) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, how many sequences are filled so), over all counts of the histogram."""
    counts, out = dict(histogram), []
    lengths = sorted(counts, reverse=True)
    for longest in lengths:
        while counts[longest]:
            counts[longest] -= 1
            rest = _filling(limit - longest, lengths, counts)
            counts[longest] += 1
            lengths_used = [longest, *rest]
            uses = {x: lengths_used.count(x) for x in set(lengths_used)}
            times = min(counts[x] // k for x, k in uses.items())
            for x, k in uses.items():
                counts[x] -= k * times
            out.append((tuple(lengths_used), times))
    return out


def _places(spark: SparkSession, histogram: dict[int, int], limit: int) -> DataFrame:
    """(length, low, high, first, offset): ranks low..high-1, in the order of lengths, go to sequences first.. at offset."""
    used = dict(zip(sorted(histogram), accumulate((histogram[x] for x in sorted(histogram)), initial=0), strict=False))
    rows, first = [], 0
    for parts, times in complete_bins(histogram, limit):
        at = 0
        for x in parts:
            rows.append((x, used[x], used[x] + times, first, at))
            used[x] += times
            at += x
        first += times
    return spark.createDataFrame(rows, "length long, low long, high long, first long, offset long")


def pack(pieces: DataFrame, limit: int = MAX_TOKENS) -> DataFrame:
    """(doc, piece, start, length, crc) with sequence and offset."""
    spark = pieces.sparkSession
    buckets = 8 * shuffle_partitions(spark)
    salted = materialize(pieces.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)).cast("int")), "pieces")
    counts = materialize(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``limit`` rows
    places = _places(spark, histogram, limit)
    bases = with_offsets(counts, [F.col("length"), F.col("salt")], F.col("n"), "base").drop("n")
    nth = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc", "piece", "start", "crc")) - 1
    ranked = salted.withColumn("nth", nth).join(bases, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("nth"))
    # the places are a few rows for each of at most ``limit`` lengths
    fits = F.broadcast(places.withColumnRenamed("length", "l"))
    placed = ranked.join(fits, (F.col("length") == F.col("l")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return placed.select("doc", "piece", "start", "length", "crc", (F.col("first") + F.col("rank") - F.col("low")).alias("sequence"), "offset")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents."""
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def packed_documents(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    placed = pack(token_pieces(docs, doc, text))
    return placed.select(
        F.col("doc").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), F.col("sequence").alias("sequence_id"), "offset"
    )
