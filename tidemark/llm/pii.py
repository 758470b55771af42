"""Personal data: exact base patterns, and terms that disclose them by corpus co-occurrence."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_skewed, save

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits that fails is not tried again from its middle, which could not match either.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TERM = re.compile(r"\w{3,}")
#: Share of an entity's information that a term may give away before it is generalised, or removed.
GENERALISE, REMOVE = 0.75, 0.9
#: Different texts in which term and entity must stand together; one meeting is no evidence.
SUPPORT = 2

Span = tuple[int, int]


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches of local@domain, found from each @ outwards: linear in the text."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def ips(text: str) -> Iterator[Span]:
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) < 3 or len(p) == 3 and p <= "255" for p in parts):
            yield m.span()


def luhn(digits: str) -> bool:
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37:
            digits = re.sub("[ -]", "", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[Span]:
    for m in PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start."""
    return [(kind, *span) for kind in KINDS for span in FINDERS[kind](text)]


def entity(kind: str, value: str) -> str:
    """The protected value that a span stands for, however it is written."""
    return f"{kind}:{value.lower() if kind == 'email' else value if kind == 'ip' else re.sub('[^0-9]', '', value)}"


def merged(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """(starts, ends) of the disjoint stretches that the spans cover."""
    starts: list[int] = []
    ends: list[int] = []
    for s, e in sorted((s, e) for _, s, e in spans):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def occurrences(text: str, spans: list[tuple[str, int, int]], actions: dict[str, str]) -> list[tuple[str, int, int]]:
    """(action, start, end) of every place outside all spans where the text has one of the terms."""
    out = []
    starts, ends = merged(spans)
    for m in TERM.finditer(text) if actions else ():
        action = actions.get(m[0].lower())
        if action:
            s, e = m.span()
            i = bisect_right(ends, s)  # the first stretch that ends after s
            if i == len(ends) or starts[i] >= e:
                out.append((action, s, e))
    return out


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Counts, base spans and entities of every row, and the text of those with an entity."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            base, digest, entities, private = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = base_spans(text or "")
                kinds = Counter(k for k, _, _ in found)
                for i, k in enumerate(KINDS):
                    counts[i].append(kinds[k])
                base.append(written(found))
                digest.append(hashlib.sha256(base[-1].encode()).hexdigest())
                entities.append(sorted({entity(k, text[s:e]) for k, s, e in found}))
                private.append(text if found else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digest), pa.array(base, pa.string()), pa.array(entities, pa.list_(pa.string())), pa.array(private, pa.string())],
                ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "base", "entities", "private"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(scanned, f"doc_id {id_type}, {counts}, base_sha256 string, base string, entities array<string>, private string")


def terms_of(text: str) -> set[str]:
    return {t.lower() for t in set(TERM.findall(text))}


def term_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, in_rows): rows whose text has the term, over all rows; counted per batch, then added up."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                counts.update(terms_of(text))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"))
    return rows.mapInArrow(counted, "term string, n long").groupBy("term").agg(F.sum("n").alias("in_rows"))


def disclosing_terms(scan: DataFrame, docs: DataFrame, n_rows: int, generalise: float = GENERALISE, remove: float = REMOVE, support: int = SUPPORT, text_col: str = "text") -> DataFrame:
    """(entity, n_entity, term, disclosure, action): how much of an entity's information a term in its rows gives away.

    disclosure = PMI(term; entity) / information of the entity
               = log2(n * n_both / (n_term * n_entity)) / log2(n / n_entity), counted over rows.
    It is 1 when the term appears nowhere without the entity. Pairs that fewer than `support`
    different texts show together are left alone. Copies of a text are listed once, with their number,
    and only under the entities that enough texts hold; terms are then counted in all of docs.
    """
    texts = scan.where(F.col("private").isNotNull()).groupBy("private").agg(F.count("*").alias("n"), F.first("entities").alias("entities"))
    texts = save(texts.withColumn("_at", F.monotonically_increasing_id()))
    held = texts.select("_at", "n", F.explode("entities").alias("entity"))
    entities = save(held.groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count("*").alias("texts")).where(F.col("texts") >= support))
    own = join_skewed(held, entities, ["entity"], "texts", "_at").groupBy("_at").agg(F.collect_list(F.struct("entity", "n_entity")).alias("own"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(terms_of(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], ["own", "n", "terms"])

    rows = texts.join(own, "_at").select("own", "n", "private").mapInArrow(listed, "own array<struct<entity:string,n_entity:long>>, n long, terms array<string>")
    each = rows.select("n", "terms", F.explode("own").alias("of")).select("of.*", "n", F.explode("terms").alias("term"))
    both = save(each.groupBy("entity", "term").agg(F.max("n_entity").alias("n_entity"), F.sum("n").alias("n_both"), F.count("*").alias("texts")).where(F.col("texts") >= support))
    scored = both.join(term_counts(docs, text_col), "term")
    pmi = F.log2(F.lit(float(n_rows)) * F.col("n_both") / (F.col("in_rows") * F.col("n_entity")))
    information = F.log2(F.lit(float(n_rows)) / F.col("n_entity"))
    scored = scored.withColumn("disclosure", F.when(information > 0, pmi / information).otherwise(F.lit(0.0)))
    action = F.when(F.col("disclosure") >= remove, F.lit("remove")).otherwise(F.lit("generalise"))
    return save(scored.where(F.col("disclosure") >= generalise).select("entity", "n_entity", "term", "disclosure", action.alias("action")))


def _actions(scan: DataFrame, row: str, flagged: DataFrame) -> DataFrame:
    """(row, actions): the terms that disclose an entity of the row, with what to do about each."""
    by_entity = flagged.groupBy("entity").agg(F.max("n_entity").alias("n"), F.collect_list(F.struct("term", "action")).alias("actions"))
    rows = join_skewed(scan.select(row, F.explode("entities").alias("entity")), save(by_entity), ["entity"], "n", row)
    return rows.groupBy(row).agg(F.flatten(F.collect_list("actions")).alias("actions"))


def _strictest(actions: list[dict[str, str]] | None) -> dict[str, str]:
    """The action for each term; two entities may ask for different ones."""
    out: dict[str, str] = {}
    for x in actions or []:
        out[x["term"]] = max(x["action"], out.get(x["term"], ""))
    return out


def _with_terms(scan: DataFrame, flagged: DataFrame) -> DataFrame:
    """scan with `terms`: the places of disclosing terms in each row, as they are written in spans."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            found = [written(sorted(occurrences(text, base_spans(text), _strictest(actions)))) for text, actions in both]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["_row", "terms"])

    hits = scan.join(_actions(scan, "_row", flagged), "_row").select("_row", "private", "actions").mapInArrow(placed, "_row long, terms string")
    return scan.join(hits, "_row", "left")


def find_personal_data(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, support: int = SUPPORT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base spans of every whole text, and the terms in it that disclose them.

    Protected entities are the values that the base patterns find. Terms are judged in the rows that
    hold such a value, wherever they stand, and found at each of their places there; a text without
    personal data keeps no span. Counts run over all rows.

    Returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (base spans as listed, then
    `generalise` and `remove` spans, each by start; code points, end exclusive). A null text counts as
    empty. Each row stands for itself, repeated ids included. Other columns are not read. An empty
    table gives an empty result.
    """
    scan = save(_scan(docs, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()))
    rows = _with_terms(scan, disclosing_terms(scan, docs, scan.count(), generalise, remove, support, text_col))
    spans = F.concat_ws(",", *[F.when(F.col(c) != "", F.col(c)) for c in ("base", "terms")])
    return rows.select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", spans.alias("spans"))


def clean(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with its spans replaced: [EMAIL] and the like, a term's general form, or nothing.

    Spans that overlap become one, named by the first.
    """
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out.append(text[at:start])
            if kind in KINDS:
                out.append(f"[{kind.upper()}]")
            elif kind == "generalise":
                term = text[start:end]
                out.append("[NUMBER]" if term.isdigit() else "[NAME]" if term[0].isupper() else "[TERM]")
        at = max(at, end)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, support: int = SUPPORT, text_col: str = "text") -> DataFrame:
    """The same rows and columns with personal data and disclosing terms replaced in the text.

    Rows without personal data go through as they are, in the scan that finds them so; only the others
    are joined with their terms. Null texts stay null.
    """
    columns = docs.columns
    inner = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    text = f"c{columns.index(text_col)}"
    schema = inner.schema

    def parted(private: bool):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(schema.names.index(text)).to_pylist()
                yield batch.filter(pa.array([any(any(True for _ in f(t)) for f in FINDERS.values()) == private if t else not private for t in texts], pa.bool_()))

        return rows

    private = save(inner.mapInArrow(parted(True), schema).withColumn("_row", F.monotonically_increasing_id()))
    scan = save(_scan(private, "_row", text).withColumnRenamed("doc_id", "_row"))
    flagged = disclosing_terms(scan, docs, docs.count(), generalise, remove, support, text_col)
    joined = private.join(_actions(scan, "_row", flagged), "_row", "left").select(*inner.columns, "actions")
    at = schema.names.index(text)

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for text_, actions in zip(batch.column(at).to_pylist(), batch.column("actions").to_pylist(), strict=True):
                found = base_spans(text_)
                new.append(clean(text_, found + occurrences(text_, found, _strictest(actions))))
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    both = inner.mapInArrow(parted(False), schema).union(joined.mapInArrow(cleaned, schema))
    return both.toDF(*columns)
