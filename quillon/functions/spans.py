"""Named spans of texts: merging what a tagger cut apart, and triples from the names of each sentence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import text as T

#: Marks that may stand before a name, marks that join two parts of one, and the types of tags.
QUOTES = "\"'`´“”„‚«»‹›‘’"
JOINERS = ["-", "’", "'", "."]
TYPES = {"PER": "Person", "LOC": "Location", "MISC": "Miscellaneous", "ORG": "Organization"}


def merged(text: Column, spans: Column) -> Column:
    """spans (start, end, label) in order, neighbours of one label put together: those with nothing, only white space or one joiner between.

    A label's B- or I- is dropped. A span that does not join the one before it opens a new one, which ends where the span
    before the next open one ends; each span is looked at once. Offsets count code points from 0. Null spans stay null,
    none give none; overlapping spans of one label are merged.
    """
    kind = "array<struct<start:int,end:int,label:string>>"
    label = lambda s: F.regexp_replace(s["label"], "^[^-]*-", "")
    own = F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), label(s).alias("label")))

    def cut(all_: Column) -> Column:
        """Places of spans that open."""

        def opens(i: Column) -> Column:
            last, s = F.get(all_, i - 1), F.get(all_, i)
            gap = F.substring(text, last["end"] + 1, F.greatest(s["start"] - last["end"], F.lit(0)))
            joins = F.coalesce((last["label"] == s["label"]) & ((gap == "") | gap.rlike(r"^[\s\p{Z}]+$") | gap.isin(JOINERS)), F.lit(False))
            return (i == 0) | ~joins

        return F.filter(F.when(F.size(all_) > 0, F.sequence(F.lit(0), F.size(all_) - 1)).otherwise(F.array().cast("array<int>")), opens)

    def whole(all_: Column, at: Column) -> Column:
        ends = lambda j: F.coalesce(F.get(at, j + 1), F.size(all_)) - 1
        return F.transform(at, lambda i, j: F.struct(F.get(all_, i)["start"].alias("start"), F.get(all_, ends(j))["end"].alias("end"), F.get(all_, i)["label"].alias("label"))).cast(kind)

    # arrays of one element name what is used more than once, so it is computed once
    found = F.transform(F.array(own), lambda all_: F.struct(all_.alias("all"), cut(all_).alias("at")))
    return F.when(spans.isNotNull(), F.transform(found, lambda x: whole(x["all"], x["at"]))[0])


def names(text: Column, spans: Column) -> Column:
    """(name, type) of merged spans, the first of those whose label and name are the same but for case and leading quotes."""
    found = F.transform(spans, lambda s: F.struct(F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("name"), s["label"].alias("label")))
    key = lambda s: F.struct(s["label"].alias("label"), F.lower(F.regexp_replace(F.regexp_replace(s["name"], r"^[\s\p{Z}]+", ""), f"^[{QUOTES}]+", "")).alias("name"))
    kind = "struct<seen:array<struct<label:string,name:string>>,out:array<struct<name:string,type:string>>>"
    types = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    start = F.struct(F.array().cast("array<struct<label:string,name:string>>").alias("seen"), F.array().cast("array<struct<name:string,type:string>>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        now = F.struct(s["name"].alias("name"), F.coalesce(F.try_element_at(types, s["label"]), s["label"]).alias("type"))
        return F.when(F.array_contains(acc["seen"], key(s)), acc).otherwise(F.struct(F.concat(acc["seen"], F.array(key(s))).alias("seen"), F.concat(acc["out"], F.array(now)).alias("out"))).cast(kind)

    return F.aggregate(found, start.cast(kind), step, lambda acc: acc["out"])


def named_triples(text: Column, found: Column) -> Column:
    """(s, r, o) of a chunk, given the names found in it: neighbours in a sentence with the words between them.

    Longer names are looked for first, so a name inside another one is only found where it stands alone. Words between
    are trimmed of marks; names that touch have the relation "is with". A repeated triple is kept once. Names are put in
    order once a chunk, texts of fewer than two names and sentences of fewer than two marks are not searched.
    """
    open_, close = "\ue000", "\ue001"  # private characters; a text's own are taken out first
    keyed = F.transform(F.filter(F.array_distinct(found), lambda n: n != ""), lambda n: F.struct((-F.length(n)).alias("size"), n.alias("name")))
    names = F.transform(F.array_sort(keyed), lambda k: k["name"])
    none = F.array().cast("array<struct<s:string,r:string,o:string>>")
    whole = f"{open_}(\\d+){close}([^{open_}]*)(?={open_}(\\d+){close})"

    def masked(longest: Column) -> Column:  # a pattern that begins with the name is found fast; what stands before it is looked at after that
        numbered = F.transform(longest, lambda n, i: F.struct(n.alias("name"), F.concat(F.lit(open_), i.cast("string"), F.lit(close)).alias("mark")))
        hide = lambda acc, n: F.when(F.contains(acc, n["name"]), F.regexp_replace(acc, F.concat(F.lit(r"\Q"), n["name"], F.lit(r"\E(?<![\p{L}\p{N}]\Q"), n["name"], F.lit(r"\E)(?![\p{L}\p{N}])")), n["mark"])).otherwise(acc)
        return F.aggregate(numbered, F.translate(text, open_ + close, ""), hide)

    def of(sentence: Column, longest: Column) -> Column:
        a, r, b = (F.regexp_extract_all(sentence, F.lit(whole), F.lit(i)) for i in (1, 2, 3))
        return F.transform(
            F.arrays_zip(a.alias("a"), r.alias("r"), b.alias("b")),
            lambda z: F.struct(F.get(longest, z["a"].cast("int")).alias("s"), F.coalesce(F.nullif(F.regexp_replace(z["r"], r"^[\s\p{P}]+|[\s\p{P}]+$", ""), F.lit("")), F.lit("is with")).alias("r"), F.get(longest, z["b"].cast("int")).alias("o")),
        )

    def triples(longest: Column) -> Column:
        told = F.filter(T.sentences(masked(longest)), lambda s: s.rlike(f"{open_}[^{open_}]*{open_}"))
        return F.array_distinct(F.filter(F.flatten(F.transform(told, lambda s: of(s, longest))), lambda t: t["s"] != t["o"]))

    # an array of one element names what is used more than once, so it is computed once
    once = F.transform(F.array(names), lambda longest: F.when(F.size(longest) > 1, triples(longest)).when(longest.isNotNull(), none))
    return F.when(text.isNotNull(), once[0])
