"""Personal information in free text: found, replaced by typed placeholders or surrogates.

Texts without any sign of personal data are set aside by two cheap patterns in
the JVM; only the others reach Python, in Arrow batches. Every detected value
gets a keyed surrogate of its type and format. Distinct entities must keep
distinct surrogates and no surrogate may be a value that occurs: entities are
compared over the whole corpus by shuffles on their digests, and those that
collide draw again, the last resort being a mark made of their own digest.
Gender and kind are settled once per entity, from all its mentions, so that one
surrogate is drawn and checked; mentions add only title, letter case and format.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanstone.llm import detect, surrogates
from gleanstone.session import materialize, where_computed

FIELDS = ("input_text", "output_text", "feedback", "error")
MAX_ALLOWED = 10_000
_ROWS = "record_id string, field_name string, pii_class string, kind string, start_pos bigint, end_pos bigint, value string, entity string, surrogate string"


def allow_list(phrases: DataFrame, column: str = "phrase") -> tuple[str, ...]:
    """The phrases that are no names; a parameter table, refused beyond ``MAX_ALLOWED`` rows."""
    rows = phrases.where(F.col(column).isNotNull()).select(column).distinct().limit(MAX_ALLOWED + 1).collect()
    if len(rows) > MAX_ALLOWED:
        raise ValueError(f"more than {MAX_ALLOWED} allow-listed phrases")
    return tuple(sorted({p for r in rows if (p := " ".join(r[0].lower().split()))}))


def _suspect(text: Column, lower: Column) -> Column:
    """Whether a text may hold personal data; cheaper signs first."""
    holds = lambda sign: F.contains(lower, F.lit(sign))
    spelled = (holds(")") | holds("]")) & lower.rlike(detect.SUSPECT_AT)
    foreign = (F.octet_length(lower) > F.length(lower)) & lower.rlike(detect.SUSPECT_FORMS)
    return holds("@") | spelled | foreign | lower.rlike(detect.SUSPECT_SIGNS) | text.rlike(detect.SUSPECT_CAPITALS)


def suspects(records: DataFrame, record_id: str = "record_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(record_id, field_name, text) of the texts that may hold personal data."""
    one = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields])
    texts = records.select(F.col(record_id).cast("string").alias("record_id"), F.inline(one)).where(F.length("text") > 3)
    lower = texts.withColumn("lower", F.lower("text"))
    return where_computed(lower, _suspect(F.col("text"), F.col("lower"))).drop("lower")


def spans(records: DataFrame, key: str, allowed: tuple[str, ...] = (), record_id: str = "record_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row per detected value with its entity digest, its surrogate still null; positions are 0-based code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for rid, field, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for s in detect.find(text, allowed):
                    out.append((rid, field, s.pii_class, s.kind, s.start, s.end, s.value, entity_digest(s, key), None))
            columns = list(zip(*out)) if out else [()] * 9
            kinds = [pa.string()] * 4 + [pa.int64()] * 2 + [pa.string()] * 3
            names = [c.split()[0] for c in _ROWS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return suspects(records, record_id, fields).mapInArrow(run, _ROWS)


def entity_digest(span: detect.Span, key: str) -> str:
    import hashlib
    import hmac

    if not key:
        raise ValueError("a secret key must be given: without one, replacements can be reversed by trial")
    return hmac.new(key.encode(), f"{span.pii_class}\x1f{surrogates.canonical(span)}".encode(), hashlib.sha256).hexdigest()[:24]


def _sex(pii_class: str, kind: str, value: str, told: str | None) -> str:
    """The sex that titles told, else that of the canonical form, which all mentions share."""
    return told if told is not None or pii_class != "NAME" else surrogates.gender(surrogates.canonical(detect.Span(0, len(value), pii_class, kind, value)))


def entities(found: DataFrame, key: str) -> DataFrame:
    """One row per entity: its class, kind, sex, a mention, and a surrogate that no other entity has and that is no entity itself.

    ``attempt`` tells how often it drew: 0 for most, 1 after a collision, -1 if only a mark helped.
    """
    # Sex as the titles tell; without or with opposed titles, as the first name's ending does.
    titled = [F.coalesce(F.max((F.col("pii_class") == "NAME") & F.col("value").rlike(p.pattern.replace("^", "(?i)^"))), F.lit(False)) for p in (surrogates._FEMALE, surrogates._MALE)]
    told = F.when(titled[0] & ~titled[1], "f").when(titled[1] & ~titled[0], "m")
    base = found.groupBy("entity").agg(*[F.min(c).alias(c) for c in ("pii_class", "kind", "value")], told.alias("sex"))

    def draw(attempt: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = list(zip(*(batch.column(i).to_pylist() for i in range(5))))
                sexes = [_sex(c, k, v, sex) for _, c, k, v, sex in rows]
                made = [surrogates.replacement(detect.Span(0, len(v), c, k, v), key, attempt, sex) for (_, c, k, v, _), sex in zip(rows, sexes)]
                digests = [entity_digest(detect.Span(0, len(m), c, k, m), key) for m, (_, c, k, _, _) in zip(made, rows)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sexes, pa.string()), pa.array(made, pa.string()), pa.array(digests, pa.string())], names=["entity", "pii_class", "kind", "value", "sex", "surrogate", "twin"])

        return run

    schema = "entity string, pii_class string, kind string, value string, sex string, surrogate string, twin string"
    first = materialize(base.mapInArrow(draw(0), schema))

    def clashes(drawn: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("pii_class", "twin").orderBy("entity"))
        ranked = drawn.withColumn("place", place)
        # A surrogate that is itself an entity of the corpus collides with it.
        taken = base.select(F.col("entity").alias("twin"), F.lit(True).alias("real"))
        return ranked.join(taken, "twin", "left").where("place > 1 or real").select("entity")

    lost = materialize(clashes(first))
    again = lost.join(first, "entity").select("entity", "pii_class", "kind", "value", "sex").mapInArrow(draw(1), schema).withColumn("attempt", F.lit(1))
    kept = first.join(lost, "entity", "left_anti").withColumn("attempt", F.lit(0))
    second = materialize(kept.unionByName(again))
    still = clashes(second.drop("attempt")).withColumn("marked", F.lit(True))
    out = second.join(still, "entity", "left")
    mark = F.concat("surrogate", F.lit("-"), "entity")
    return out.select("entity", "pii_class", "kind", "value", "sex", F.when(F.col("marked"), mark).otherwise(F.col("surrogate")).alias("surrogate"), F.when(F.col("marked"), -1).otherwise(F.col("attempt")).alias("attempt"))


def occurrences(records: DataFrame, key: str, allowed: tuple[str, ...] = (), record_id: str = "record_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Every occurrence with its entity's surrogate, once: rows repeated whole are one.

    Null and empty texts hold nothing; texts are searched whole; empty tables give no rows.
    """
    found = materialize(spans(records, key, allowed, record_id, fields).dropDuplicates(["record_id", "field_name", "start_pos"]))
    known = entities(found, key).select("entity", F.col("kind").alias("settled"), "sex", "attempt")
    names = [c.split()[0] for c in _ROWS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for c, v, entity, kind, sex, attempt in zip(*(batch.column(n).to_pylist() for n in ("pii_class", "value", "entity", "settled", "sex", "attempt"))):
                new = surrogates.replacement(detect.Span(0, len(v), c, kind, v), key, abs(attempt), sex)
                made.append(new if attempt >= 0 else f"{new}-{entity}")
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names[:-1]), pa.array(made, pa.string())], names=names)

    return found.join(known, "entity").select(*names, "settled", "sex", "attempt").mapInArrow(run, _ROWS)


def redacted(records: DataFrame, key: str, allowed: tuple[str, ...] = (), style: str = "placeholder", record_id: str = "record_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``records`` with the values in ``fields`` replaced; all other text, columns and rows stay as they are.

    ``style`` is ``placeholder`` (the class and the 96-bit digest, ``[NAME_1f2e3d4c...]``, one per entity) or
    ``surrogate``, which joins every occurrence's surrogate to its row.
    """
    if style == "surrogate":
        return _with_surrogates(records, key, allowed, fields)

    def replace(text: str) -> str:
        out, at = [], 0
        for s in detect.find(text, allowed):
            out += [text[at : s.start], f"[{s.pii_class}_{entity_digest(s, key)}]"]
            at = s.end
        return "".join(out) + text[at:]

    @F.pandas_udf("string")
    def change(texts):  # noqa: ANN001, ANN202
        return texts.map(lambda t: replace(t) if t else t, na_action="ignore")

    out = records
    for f in fields:
        # Lowered once, in a projection of its own; texts without a sign come back null, so that each sign is looked for once.
        out = out.withColumn("__lower", F.lower(F.col(f)))
        out = out.withColumn(f, F.coalesce(change(F.when(_suspect(F.col(f), F.col("__lower")), F.col(f))), F.col(f)))
    return out.drop("__lower")


def _with_surrogates(records: DataFrame, key: str, allowed: tuple[str, ...], fields: tuple[str, ...]) -> DataFrame:
    rows = materialize(records.withColumn("__row", F.monotonically_increasing_id().cast("string")))
    found = occurrences(rows, key, allowed, "__row", fields)
    edits = found.groupBy(F.col("record_id").alias("__row")).agg(F.collect_list(F.struct("start_pos", "end_pos", "surrogate", "field_name")).alias("__edits"))
    out = rows.join(edits, "__row", "left")
    for f in fields:
        mine = f"array_sort(filter(__edits, e -> e.field_name = '{f}'))"
        step = f"(a, e) -> struct(concat(a.text, substring(`{f}`, int(a.at) + 1, int(e.start_pos - a.at)), e.surrogate) AS text, e.end_pos AS at)"
        changed = F.expr(f"aggregate({mine}, struct('' AS text, 0L AS at), {step}, a -> concat(a.text, substring(`{f}`, int(a.at) + 1)))")
        out = out.withColumn(f, F.coalesce(changed, F.col(f)))
    return out.select(*records.columns)
