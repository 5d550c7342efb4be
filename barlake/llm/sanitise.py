"""Personal data: fixed patterns, and terms that give a protected entity away by co-occurrence.

The base spans are e-mail addresses, IP addresses, card and phone numbers (`base_spans`). Their values are the
protected entities. What stands around an entity can reveal it even when the entity itself is masked, so the
corpus is asked how strongly: with df(t) the documents that hold term t, df(t, e) those that hold t within
`REACH` words of entity e, and df(e) those that hold e, of N documents,

    P(e | t) = df(t, e) / df(t)          base rate b = df(e) / N          disclosure = log2( P(e | t) / b ) bits

A term is a disclosing one for e if P(e | t) is at least `LEAST_SHARE`, no chance product of the base rate, that
is (P(e | t) - b) / sqrt(b (1 - b) / df(t)) at least `LEAST_DEVIATIONS`, which holds for rare entities and for one in a third of all rows
alike, whatever the number of rows, and if the pair occurs in at least two documents and two different surroundings, so that copies are no evidence. Where it
stands within reach of e it becomes a span of kind `term`; outside it discloses nothing and stays. `masked`
generalises spans to the name of their kind.

All counts are over all documents. Null and empty texts have no spans. Repeated rows and copies are treated
alike. Rows with a null doc_id are kept. The added columns of the results are named in the functions.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake import session
from barlake.llm.common import fixed_hash, free_names, rows, table, texts

KINDS = ("email", "ip", "card", "phone")
REACH = 8
LEAST_SHARE = 0.5
LEAST_DEVIATIONS = 4.0
#: A worker hands its word counts on when it holds this many.
TERMS_HELD = 200_000

_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_local_tail = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match always begins at the first digit of its run, so none is sought inside a run.
_ip = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_word = re.compile(r"\w+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the address pattern: each `@` with the run of local characters before it and its domain."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _local:
            start -= 1
        if start < at and (m := _domain.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _ip.finditer(text):
        if all(len(p) < 4 and int(p) < 256 or not p.lstrip("0") or len(p.lstrip("0")) < 4 and int(p.lstrip("0")) < 256 for p in m.groups()):
            yield m.span()


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _card.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _phone.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            yield m.span()


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each of KINDS, leftmost first, in code points with the end excluded."""
    return [
        list(_emails(text)) if "@" in text else [],
        list(_ips(text)),
        list(_cards(text)),
        list(_phones(text)) if "+" in text else [],
    ]


def _listed(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, own in zip(KINDS, spans, strict=True) for a, b in own)


NEAR = pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.string()), ("around", pa.int64()), ("first", pa.int32()), ("last", pa.int32())]))
FOUND = "doc_id long, row long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, near array<struct<entity:long,term:string,around:long,first:int,last:int>>"


def _near(text: str, spans: list[list[tuple[int, int]]]) -> list[dict]:
    """Terms within reach of each entity of a text, with a hash of the surroundings."""
    flat = sorted(x for own in spans for x in own)
    if not flat:
        return []
    words = [m.span() for m in _word.finditer(text)]
    starts = [w[0] for w in words]
    ends = [b for _, b in flat]

    def free(a: int, b: int) -> bool:
        k = bisect_left(ends, a + 1)
        return k == len(flat) or all(x >= b for x, _ in flat[k : k + 4])

    out = []
    for a, b in flat:
        lo, hi = bisect_left(starts, a), bisect_left(starts, b)
        side = [w for w in words[max(0, lo - REACH) : lo] + words[hi : hi + REACH] if free(*w)]
        value = re.sub(r"[ ().-]", "", text[a:b]) if text[a] in "+0123456789" and "@" not in text[a:b] and text.count(".", a, b) < 3 else text[a:b].lower()
        terms = [text[x:y].lower() for x, y in side]
        entity, around = fixed_hash([value, " ".join(terms)]).astype(np.int64).tolist()
        out += [{"entity": entity, "term": t, "around": around, "first": x, "last": y} for t, (x, y) in zip(terms, side, strict=True)]
    return out


def scanned(docs: DataFrame) -> DataFrame:
    """Per row the base spans, and the terms near them; `row` is a hash that equal rows share."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("base", pa.string()), ("near", NEAR)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = texts(b, "text")
            spans = list(map(base_spans, own))
            listed = list(map(_listed, spans))
            counts = {f"n_{k}": [len(s[i]) for s in spans] for i, k in enumerate(KINDS)}
            shas = [hashlib.sha256(x.encode()).hexdigest() for x in listed]
            yield rows({"doc_id": b.column("doc_id"), "row": b.column("row"), **counts, "base_sha256": shas, "base": listed, "near": list(map(_near, own, spans))}, schema)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row().alias("row"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, FOUND)


def _row() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def term_counts(docs: DataFrame) -> DataFrame:
    """term and df, the number of rows whose text holds it; tasks count before anything is shuffled."""
    schema = pa.schema([("term", pa.string()), ("df", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for b in batches:
            for t in texts(b, "text"):
                held.update(set(_word.findall(t.lower())))
                if len(held) > TERMS_HELD:
                    yield rows({"term": list(held), "df": list(held.values())}, schema)
                    held.clear()
        yield rows({"term": list(held), "df": list(held.values())}, schema)

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def disclosing(found: DataFrame, docs: DataFrame, share: float = LEAST_SHARE, deviations: float = LEAST_DEVIATIONS) -> DataFrame:
    """entity and term of each pair whose disclosure is over the thresholds, with the figures."""
    near = found.select("row", F.explode("near").alias("x")).select("row", "x.entity", "x.term", "x.around")
    pairs = near.groupBy("entity", "term", "row").agg(F.min("around").alias("lo"), F.max("around").alias("hi"), F.count(F.lit(1)).alias("times"))
    pairs = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("together"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    entities = near.select("entity", "row").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("entity_df"))
    joined = pairs.filter("lo <> hi AND together > 1").join(term_counts(docs), "term").join(entities, "entity")
    rate = F.col("entity_df") / F.greatest(F.lit(docs.count()), F.col("entity_df") + 1)
    joined = joined.withColumn("share", F.least(F.lit(1.0), F.col("together") / F.col("df"))).withColumn("bits", F.log2(F.col("share") / rate))
    above = (F.col("share") - rate) / F.sqrt(rate * (1 - rate) / F.col("df"))
    return joined.filter((F.col("share") >= share) & (above >= deviations))


def _term_spans(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """row and `terms`, the sorted distinct spans of its disclosing terms."""
    near = found.select("row", F.explode("near").alias("x")).select("row", "x.entity", "x.term", "x.first", "x.last")
    spans = near.join(pairs.select("entity", "term"), ["entity", "term"]).select("row", F.struct("first", "last").alias("span"))
    return spans.groupBy("row").agg(F.array_sort(F.collect_set("span")).alias("terms"))


def _joined(base: Column, terms: Column) -> Column:
    listed = F.array_join(F.transform(terms, lambda x: F.concat_ws(":", F.lit("term"), x["first"], x["last"])), ",")
    return F.concat_ws(",", F.when(base != "", base), F.when(F.size(terms) > 0, listed))


def spans(docs: DataFrame, share: float = LEAST_SHARE, deviations: float = LEAST_DEVIATIONS) -> DataFrame:
    """doc_id, row, counts and hash of the base spans, and `spans`, all of them as kind:start:end."""
    found = session.cut(scanned(docs))
    pairs = session.cut(disclosing(found, docs, share, deviations).select("entity", "term"))
    terms = _term_spans(found, pairs)
    return found.drop("near").join(terms, "row", "left").withColumn("spans", _joined(F.col("base"), F.col("terms"))).drop("terms", "base")


def masked(docs: DataFrame, share: float = LEAST_SHARE, deviations: float = LEAST_DEVIATIONS) -> DataFrame:
    """docs with every span of its text replaced by its kind in angle brackets; n_chars, if there, follows."""
    row, marks_ = free_names(docs.columns, ("row", "marks"))
    held = spans(docs, share, deviations).filter("spans <> ''").dropDuplicates(["row"]).select(F.col("row").alias(row), F.col("spans").alias(marks_))
    joined = docs.withColumn(row, _row()).join(held, row, "left").drop(row)
    names = docs.columns

    def cleaned(text: str | None, listed: str | None) -> str | None:
        if not listed:
            return text
        out, at = [], 0
        for a, b, kind in sorted((int(a), int(b), kind) for kind, a, b in (x.split(":") for x in listed.split(","))):
            if a >= at:
                out += [text[at:a], f"<{kind}>"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, marks = b.column("text").to_pylist(), b.column(marks_).to_pylist()
            new = own if not any(marks) else list(map(cleaned, own, marks))
            values = {n: b.column(n) for n in names} | {"text": new}
            if "n_chars" in names:
                values["n_chars"] = [n if not m else len(t) for n, m, t in zip(b.column("n_chars").to_pylist(), marks, new, strict=True)]
            yield rows(values, pa.schema([b.schema.field(n) for n in names]))

    return joined.mapInArrow(run, joined.select(*names).schema)


def op9_disclosure_spans(spark, sf_dir: str) -> DataFrame:
    """The contract's result: counts, hash of the base spans and all spans of every document."""
    return spans(table(spark, sf_dir, "documents")).drop("row")
