"""Canonical Unicode normalisation and folding as Spark expressions, from Python's character data."""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space beyond ASCII's.
BLANKS = "\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"


def char_class(points: list[int]) -> str:
    """Inside of a regex class for code points."""
    out, i = [], 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        out.append(f"\\x{{{points[i]:X}}}" + (f"-\\x{{{points[j]:X}}}" if j > i else ""))
        i = j + 1
    return "".join(out)


@cache
def tables() -> dict:
    """Marks with their classes, full decompositions, primary compositions, one-to-one mappings, exclusions."""
    classes, apart, pairs, single, excluded = {}, {}, {}, {}, []
    for point in range(sys.maxunicode + 1):
        c = chr(point)
        if 0xD800 <= point <= 0xDFFF or 0xAC00 <= point <= 0xD7A3:
            continue
        if k := unicodedata.combining(c):
            classes[c] = k
        full = unicodedata.normalize("NFD", c)
        if full == c:
            continue
        nfc = unicodedata.normalize("NFC", c)
        if nfc == c:
            apart[c] = full
            first = "".join(chr(int(x, 16)) for x in unicodedata.decomposition(c).split())
            if len(first) == 2:
                pairs[unicodedata.normalize("NFC", first[0]) + first[1]] = c
        elif len(nfc) == 1:
            single[c] = nfc
            apart[c] = full
        else:
            excluded.append(point)
            apart[c] = full
    marks = char_class(sorted(map(ord, classes)))
    # Starters that join what stands before them: some Indic vowel signs, and vowels and finals of Hangul.
    joining = char_class(sorted({ord(p[-1]) for p in pairs if not unicodedata.combining(p[-1])} | set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))))
    return {"classes": classes, "apart": apart, "pairs": pairs, "single": single, "marks": marks, "joining": joining, "trigger": marks + joining + char_class(excluded)}


def _map(values: dict, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values)), f"map<string,{kind}>")


def hangul(a: Column, b: Column) -> Column:
    """The syllable that a leading consonant and a vowel, or an open syllable and a final, make; else null."""
    x, y = F.ascii(a), F.ascii(b)
    open_ = x.between(0xAC00, 0xD7A3) & ((x - 0xAC00) % 28 == 0) & y.between(0x11A8, 0x11C2)
    point = F.when(x.between(0x1100, 0x1112) & y.between(0x1161, 0x1175), 0xAC00 + ((x - 0x1100) * 21 + (y - 0x1161)) * 28).when(open_, x + y - 0x11A7)
    return F.decode(F.unhex(F.lpad(F.hex(point), 4, "0")), "UTF-16BE")


def compose(text: Column) -> Column:
    """Canonical composition (NFC). Texts without anything that joins only need one-to-one mappings."""
    t = tables()
    apart, classes, pairs = _map(t["apart"], "string"), _map(t["classes"], "int"), _map(t["pairs"], "string")

    def ordered(run: Column) -> Column:
        marks = F.transform(F.split(run, ""), lambda x, i: F.struct(F.coalesce(F.element_at(classes, x), F.lit(0)).alias("k"), i.alias("i"), x.alias("c")))
        return F.when(F.char_length(run) == 1, run).otherwise(F.array_join(F.transform(F.array_sort(marks), lambda m: m["c"]), ""))

    def cluster(c: Column) -> Column:
        whole = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.element_at(apart, x), x)), "")
        runs = F.regexp_extract_all(whole, F.lit(f"(?s)[{t['marks']}]+|."), 0)
        chars = F.split(F.array_join(F.transform(runs, ordered), ""), "")
        start = F.struct(F.lit("").alias("out"), F.lit("").alias("s"), F.lit("").alias("rest"), F.lit(0).alias("last"))

        def step(acc: Column, m: Column) -> Column:
            k = F.coalesce(F.element_at(classes, m), F.lit(0))
            joined = F.coalesce(F.element_at(pairs, F.concat(acc["s"], m)), hangul(acc["s"], m))
            fits = joined.isNotNull() & (acc["s"] != "") & F.when(k > 0, acc["last"] < k).otherwise(acc["rest"] == "")
            starter = ~fits & (k == 0)
            return F.struct(
                F.when(starter, F.concat(acc["out"], acc["s"], acc["rest"])).otherwise(acc["out"]).alias("out"),
                F.when(fits, joined).when(starter, m).otherwise(acc["s"]).alias("s"),
                F.when(fits, acc["rest"]).when(starter, F.lit("")).otherwise(F.concat(acc["rest"], m)).alias("rest"),
                F.when(fits, acc["last"]).when(starter, F.lit(0)).otherwise(k).alias("last"),
            )

        return F.aggregate(chars, start, step, lambda acc: F.concat(acc["out"], acc["s"], acc["rest"]))

    joins = t["marks"] + t["joining"]
    clusters = F.regexp_extract_all(text, F.lit(f"(?s)[^{joins}][{joins}]*|[{joins}]+"), 0)
    plain = F.translate(text, "".join(t["single"]), "".join(t["single"].values()))
    # Nothing below U+0300 is a mark or changes; the test spares most texts the long class.
    return F.when(~text.rlike("[^\\x{0}-\\x{2FF}]"), text).when(text.rlike(f"[{t['trigger']}]"), F.array_join(F.transform(clusters, cluster), "")).otherwise(plain)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once, however often use refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def canonical(text: Column) -> Column:
    """Composed, case folded and composed again; white space runs as one space, none at the ends.

    Both rounds go through one copy of the expression, as its tables make the plan large.
    """

    def step(now: Column, fold: Column) -> Column:
        # Catalyst takes lower(upper(x)) for lower(x), which folds less; bound apart, both stay.
        folded = F.translate(once(F.upper(now), F.lower), "ς", "σ")
        return once(F.when(fold, folded).otherwise(now), compose)

    twice = F.aggregate(F.array(F.lit(False), F.lit(True)), text, step)
    return F.trim(F.regexp_replace(twice, f"[{BLANKS}]+", " "))
