"""Entities, relations, key phrases, relevance and text structure without external models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import is_upper, let, py_strip, word_count
from .sentences import Known, pieces, sentences, stripped

#: Labels that count for relevance (fixed values).
IMPORTANT = ["PERSON", "ORG", "MONEY", "DATE", "LOC"]
NEAR, PHRASES = 50, 5
#: The language of the rules, said of every text.
LANGUAGE = "fr"
#: Entities by rule: capitalised words of Latin letters, and numbers; years are dates.
_NAME, _NUMBER, _YEAR = "^\\p{Lu}\\p{Ll}{3,}\\W*$", "^[0-9]{2,}\\W*$", "^(19|20)[0-9]{2}\\W*$"
#: The places before tokens that are one of these.
_BEFORE = "(?<=[ \n])(?=(?:\\p{Lu}\\p{Ll}{3,}|[0-9]{2,})[^\\w \n]*(?![^ \n]))"


def entities(text: Column, names: Column | None = None) -> Column:
    """structs (text, label, start, end, pos, confidence), in the order of their places; start counts characters, pos tokens between single spaces and line ends.

    Tokens by rule; names (spans of ``names.find_names``) stand before all tokens that they overlap.
    """
    found = _by_rule(text)
    if names is None:
        return found
    before = lambda s: F.size(F.split(F.substring(text, F.lit(1), s["start"]), "[ \n]")) - 1
    words = lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"])
    own = F.transform(names, lambda s: F.struct(words(s).alias("text"), s["label"].alias("label"), s["start"].alias("start"), s["end"].alias("end"), before(s).alias("pos"), F.lit(1.0).alias("confidence")))
    apart = F.filter(found, lambda e: ~F.exists(names, lambda s: (e["start"] < s["end"]) & (s["start"] < e["end"])))
    placed = F.array_sort(F.transform(F.concat(apart, own), lambda e: F.struct(e["start"].alias("at"), e.alias("e"))))
    return F.transform(placed, lambda x: x["e"])


def _by_rule(text: Column) -> Column:
    label = lambda t: F.when(t.rlike(_YEAR), "DATE").when(t.rlike(_NUMBER), "CARDINAL").when(t.rlike(_NAME), "PERSON")
    none = F.array().cast("array<struct<text:string,label:string,start:int,end:int,pos:int,confidence:double>>")

    def step(acc: Column, x: Column) -> Column:
        own = F.struct(x["body"].alias("text"), x["label"].alias("label"), acc["at"].alias("start"), (acc["at"] + F.length(x["body"])).alias("end"), acc["pos"].alias("pos"), F.lit(1.0).alias("confidence"))
        out = F.when(x["label"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(own)))
        return F.struct((acc["at"] + x["wide"]).alias("at"), (acc["pos"] + x["tokens"]).alias("pos"), out.alias("out"))

    def piece(s: Column) -> Column:
        token = F.regexp_extract(s, "^[^ \n]*", 0)
        wide = F.length(s)
        return F.struct(F.regexp_replace(token, "(?U)\\W+$", "").alias("body"), label(token).alias("label"), wide.alias("wide"), (wide - F.length(F.translate(s, " \n", ""))).alias("tokens"))

    # each piece begins with an entity and goes on to the next; only the first need not
    pieces_ = F.transform(F.split(text, _BEFORE), piece)
    return F.aggregate(pieces_, F.struct(F.lit(0).alias("at"), F.lit(0).alias("pos"), none.alias("out")), step, lambda acc: acc["out"])


def structure(text: Column, known: Known = ()) -> Column:
    """sentences (known: abbreviations learnt from the corpus) with their kind; short upper-case ones are headings."""
    return _kinds(sentences(text, known))


def _kinds(found: Column) -> Column:
    return F.transform(found, lambda s: F.struct(s.alias("text"), F.when(is_upper(s) & (word_count(s) <= 10), "heading").otherwise("paragraph").alias("kind")))


def relations(entities: Column, near: int = NEAR) -> Column:
    """Pairs i < j of an array of structs (text, pos) less than ``near`` tokens apart; within one row, no self-join.

    Entities may come in any order and share positions. Each looks ahead only while those behind it, in the order
    of positions, are near; the pair names them in the order of the array.
    """
    ranked = F.array_sort(F.transform(entities, lambda e, i: F.struct(e["pos"].alias("pos"), i.alias("i"), e["text"].alias("text"))))

    def pair(a: Column, b: Column) -> Column:
        swap = a["i"] > b["i"]
        one, two = F.when(swap, b["text"]).otherwise(a["text"]), F.when(swap, a["text"]).otherwise(b["text"])
        return F.struct(one.alias("entity1"), two.alias("entity2"), F.lit("proximity").alias("type"), (b["pos"] - a["pos"]).alias("distance"))

    def found(x: Column) -> Column:
        # at different positions at most near - 1 entities can follow that near; shared positions need all of them looked at
        far = lambda a, i, n: F.coalesce(F.get(x["all"], i + n)["pos"] - a["pos"] >= near, F.lit(True))
        most = lambda a, i: F.when(far(a, i, 5), 4).when(far(a, i, 13), 12).otherwise(x["most"])
        ahead = lambda a, i: F.filter(F.slice(x["all"], i + 2, most(a, i)), lambda b: b["pos"] - a["pos"] < near)
        return F.flatten(F.transform(x["all"], lambda a, i: F.transform(ahead(a, i), lambda b: pair(a, b))))

    def bounded(all_: Column) -> Column:
        apart = F.size(F.array_distinct(F.transform(all_, lambda e: e["pos"]))) == F.size(all_)
        return F.struct(all_.alias("all"), F.when(apart, F.lit(near - 1)).otherwise(F.size(all_)).alias("most"))

    return let(let(ranked, bounded), found)


def key_phrases(text: Column, entities: Column, most: int = PHRASES, known: Known = ()) -> Column:
    """The first sentences within which an entity (struct with its first character's place, start) begins."""
    return _phrases(pieces(text, known), entities, most)


def _phrases(cut: Column, entities: Column, most: int = PHRASES) -> Column:
    def found(starts: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            end = acc["at"] + F.length(s)
            holds = (F.size(acc["out"]) < most) & F.exists(starts, lambda x: (x >= acc["at"]) & (x < end))
            return F.struct(end.alias("at"), F.when(holds, F.concat(acc["out"], F.array(py_strip(s)))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(cut, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step, lambda acc: acc["out"])

    return let(F.transform(entities, lambda e: e["start"]), found)


def relevance(tokens: Column, entities: Column, important: Column) -> Column:
    """F23."""
    score = 0.5 * entities / F.greatest(tokens, F.lit(1)) + 0.5 * important / F.greatest(entities, F.lit(1))
    return F.when(tokens == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), score))


def enrich(text: Column, names: Column | None = None, known: Known = ()) -> Column:
    """All of a text's additions in one struct; relevance takes the place of a confidence. names and known as in ``entities`` and ``structure``."""

    def whole(x: Column) -> Column:
        found, cut, said, tokens = x["found"], x["cut"], x["said"], x["tokens"]
        important = F.size(F.filter(found, lambda e: e["label"].isin(IMPORTANT)))
        score = relevance(tokens, F.size(found), important)
        return F.struct(
            found.alias("entities"), _kinds(said).alias("structure"), relations(found).alias("relations"), _phrases(cut, found).alias("key_phrases"), F.lit(LANGUAGE).alias("language"),
            tokens.alias("token_count"), F.size(said).alias("sentence_count"), score.alias("relevance_score"), score.alias("confidence"),
        )

    made = lambda cut: F.struct(entities(text, names).alias("found"), cut.alias("cut"), stripped(cut).alias("said"), word_count(text).alias("tokens"))
    return let(let(pieces(text, known), made), whole)


def heading_level(style: Column) -> Column:
    """the last token of a style name as a number, else 1."""
    return F.coalesce(F.element_at(F.split(style, "\\s+"), -1).try_cast("int"), F.lit(1))


def span_structure(spans: Column, large: float = 12.0) -> Column:
    """spans (text, size) that aren't blank; large ones are headings."""
    return F.transform(F.filter(spans, lambda s: F.trim(s["text"]) != ""), lambda s: F.struct(F.trim(s["text"]).alias("text"), F.when(s["size"] > large, "heading").otherwise("paragraph").alias("kind")))
