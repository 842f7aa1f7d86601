"""Abbreviations from a table of any size, found with a multi-pattern automaton."""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askloom.session import materialize

#: Bytes of abbreviations and full texts in one broadcast.
GROUP_BYTES = 4 << 20

_MATCHES = "array<struct<start:int,stop:int,short:string,full:string>>"
_FIELDS = {"start": pa.int32(), "stop": pa.int32(), "short": pa.string(), "full": pa.string()}
_built: dict[str, object] = {}


@lru_cache(maxsize=1 << 16)
def _is_word(char: str) -> bool:
    """What ``\\b`` counts as part of a word under Unicode rules."""
    kind = unicodedata.category(char)
    return kind[0] in "LM" or kind in ("Nd", "Nl", "Pc") or char in "\u200c\u200d" or 0x24B6 <= ord(char) <= 0x24E9


class _Fold(dict):
    """Case folding character by character, so that places stay the same."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        upper = char.upper()
        self[code] = ((upper if len(upper) == 1 else char).lower() or char)[0]
        return self[code]


_FOLD = _Fold()


def _folded(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_FOLD)


def automaton(pairs: Iterable[tuple[str, str]]):
    """Automaton over the folded abbreviations; of equal ones the smallest pair counts."""
    import ahocorasick

    best: dict[str, tuple[str, str]] = {}
    for short, full in pairs:
        key = _folded(short)
        best[key] = min(best.get(key, (short, full)), (short, full))
    machine = ahocorasick.Automaton()
    for key, pair in best.items():
        machine.add_word(key, (len(key), *pair))
    if best:
        machine.make_automaton()
    return machine


def find(machine, text: str) -> Iterator[tuple[int, int, str, str]]:
    """All whole-word matches ``(start, stop, short, full)``, overlapping ones too."""
    if not len(machine):
        return
    end = len(text)
    for last, (length, short, full) in machine.iter(_folded(text)):
        start, stop = last - length + 1, last + 1
        before = start > 0 and _is_word(text[start - 1])
        after = stop < end and _is_word(text[stop])
        if before != _is_word(text[start]) and after != _is_word(text[last]):
            yield start, stop, short, full


def substitute(text: str, matches: Iterable[tuple[int, int, str, str]]) -> str:
    """The text with its matches expanded: leftmost first, the longest of one start, none overlapping."""
    pieces, place = [], 0
    for start, stop, short, full in sorted(matches, key=lambda m: (m[0], -m[1], m[2], m[3])):
        if start >= place:
            pieces += [text[place:start], f"{short} ({full})"]
            place = stop
    return "".join([*pieces, text[place:]]) if pieces else text


def _machine(shared):
    """The automaton of a broadcast, built once in a worker; the last one stays."""
    if shared.value["id"] not in _built:
        _built.clear()
        _built[shared.value["id"]] = automaton(shared.value["pairs"])
    return _built[shared.value["id"]]


def _expander(shared):
    def expand(texts: pa.Array) -> pa.Array:
        machine = _machine(shared)
        whole = (t.as_py() for t in texts)
        return pa.array((t if t is None else substitute(t, find(machine, t)) for t in whole), pa.string())

    return F.arrow_udf(expand, T.StringType())


def _finder(shared):
    def matches(texts: pa.Array) -> pa.Array:
        machine = _machine(shared)
        whole = (t.as_py() for t in texts)
        found = ([] if t is None else [dict(zip(_FIELDS, m)) for m in find(machine, t)] for t in whole)
        return pa.array(found, pa.list_(pa.struct(list(_FIELDS.items()))))

    return F.arrow_udf(matches, _MATCHES)


def _substitute_all(texts: pa.Array, found: pa.Array) -> pa.Array:
    rows = ((t.as_py(), m.as_py()) for t, m in zip(texts, found))
    return pa.array((t if t is None else substitute(t, [tuple(x.values()) for x in m]) for t, m in rows), pa.string())


def expand_from_table(
    df: DataFrame,
    text: str,
    pairs: DataFrame,
    short: str = "short",
    full: str = "full",
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """``df`` with each whole-word, case-insensitive abbreviation of ``text`` as ``SHORT (full text)``.

    One pass over a text finds all abbreviations at once; where they overlap the leftmost counts, then the
    longest. Full texts are not searched again, so as long as no full text holds an abbreviation and none
    overlap the result is that of replacing pair after pair. Pairs that lack a side or have an empty
    abbreviation are left out; of abbreviations equal but for case the smallest pair counts. Null texts
    stay null; all other columns stay as they are.

    The pairs are counted first. Up to ``group_bytes`` they are broadcast as a whole; more are broadcast in
    groups of about that size, one narrow pass over the texts each, whose matches are stored and settled
    together at the end. Texts are never shuffled, and no worker holds more than one group.
    """
    spark = df.sparkSession
    known = pairs.select(F.col(short).alias("short"), F.col(full).alias("full"))
    known = known.where("short <> '' AND full IS NOT NULL").distinct()
    size = F.octet_length("short") + F.octet_length("full") + F.lit(32)
    stored = materialize(known.withColumn("bytes", size.cast("long")), "abbreviations")
    total = stored.agg(F.sum("bytes")).first()[0] or 0
    groups = max(1, -(-total // group_bytes))

    def shared(group: int):
        own = stored.where(F.pmod(F.xxhash64("short"), F.lit(groups)) == group)
        value = [(r.short, r.full) for r in own.select("short", "full").collect()]
        return spark.sparkContext.broadcast({"id": uuid.uuid4().hex, "pairs": value})

    if groups == 1:
        return df.withColumn(text, _expander(shared(0))(F.col(text)))
    rows = df.withColumn("__found", F.array().cast(_MATCHES))
    for group in range(groups):
        more = rows.withColumn("__new", _finder(shared(group))(F.col(text)))
        rows = materialize(more.withColumn("__found", F.concat("__found", "__new")).drop("__new"), "matches")
    settle = F.arrow_udf(_substitute_all, T.StringType())
    return rows.withColumn(text, settle(F.col(text), F.col("__found"))).select(*df.columns)
