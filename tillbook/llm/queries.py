"""The numbered operators as registered queries over the whole tables, with DuckDB SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillbook.llm import (
    alignment,
    hamming,
    jaccard,
    licenses,
    lloyd,
    mixing,
    packing,
    quality,
    simhash,
    spotsigs,
    suffixes,
    surrogates,
    training_order,
)
from tillbook.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query(
    "op9_mixing",
    r"""
    with sized as (
        select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents
    ), sources as (
        select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as place
        from sized group by source
    ), weighed as (
        select *, (place % 3 + 1)::double as weight, [0.5, 0.0, -0.5][place % 3 + 1]::double as tilt,
            (3 * source_size)::double as stop
        from sources
    ), levels as (
        select *, stop / weight as ratio,
            (sum(source_size) over ())::double
                - coalesce(sum(stop) over (order by stop / weight, place rows between unbounded preceding and 1 preceding), 0) as remaining,
            sum(weight) over (order by stop / weight, place rows between current row and unbounded following) as weight_left
        from weighed
    ), level as (
        select coalesce(min_by(remaining / weight_left, ratio) filter (where remaining / weight_left <= ratio), 0) as height from levels
    ), targets as (
        select source, source_size, tilt, least(weight * height, stop) as target from weighed, level
    ), placed as (
        select s.*, t.source_size, t.target, t.tilt, coalesce(sum(s.size) over (partition by s.source
            order by md5('mix:' || s.doc_id::varchar), s.doc_id rows between unbounded preceding and 1 preceding), 0)::double
            + s.size / 2.0::double as middle
        from sized s join targets t on s.source is not distinct from t.source
    ), taken as (
        select *, case when source_size = 0 then 1 else greatest(0, ceil((target - middle) / source_size)) end::int as copies,
            case when target > 0 then least(1.0, middle / target) else 0 end::double as share
        from placed
    )
    select doc_id, size, source_size, target, (size * copies)::bigint as taken, copies,
        case when copies = 0 then null when tilt = 0 then share
            else (sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * share) - (1 - tilt)) / (2 * tilt) end::double as position
    from taken
    """,
)
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return plan.orderBy("position", "doc_id").select(
        "doc_id", "size", "source_size", "target", "taken", "copies", "position"
    )


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query("op5_quality_classifier")
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score_quality(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


@query("op6_pii_surrogates")
def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace_entities(docs, count="entities")


@query("op2_ngram_jaccard_join")
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_sets(table(spark, sf_dir, "documents"), n=4, percent=85)


@query("op10_spotsigs_fingerprints")
def op10_spotsigs_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edit_check(table(spark, sf_dir, "documents"))


@query(
    "op1_exact_topk_hamming",
    """
    with coded as (
        select vec_id, list_transform(embedding, lambda x: x > 0) as bits from embeddings where embedding is not null
    ), pairs as (
        select q.vec_id as query_id, r.vec_id as neighbour_id,
            len(list_filter(list_zip(q.bits, r.bits), lambda p: p[1] <> p[2]))::int as distance
        from coded q join coded r on true where q.vec_id % 100 = 0
    )
    select query_id, row_number() over (partition by query_id order by distance, neighbour_id)::int as rank,
        neighbour_id, distance
    from pairs qualify rank <= 10
    """,
)
def op1_exact_topk_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), hamming.sign_code(F.col("embedding")).alias("code")
    )
    return hamming.top_k(coded, coded.filter("id % 100 = 0"))


def _licenses_sql() -> str:
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in licenses.TEMPLATES.items())
    words = r"string_split(trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')"
    pairs = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
    return f"""
    with templates as (
        select license, {pairs.format("w")} as template from (
            select license, {words.format("t")} as w from (values {values}) v(license, t))
    ), units as (
        select distinct doc_id, unit from (
            select doc_id, unnest(list_concat(string_split(text, chr(10)),
                string_split_regex(text, '\\n[\\s]*\\n'), [text])) as unit from documents)
    ), cut as (
        select doc_id, {pairs.format("w")} as pairs from (
            select doc_id, {words.format("unit")} as w from units) where len(w) > 1
    ), scored as (
        select doc_id, license, 2.0::double * len(list_intersect(pairs, template)) / (len(pairs) + len(template)) as dice
        from cut join templates on len(pairs) * 3 >= len(template) * 2 and len(pairs) * 2 <= len(template) * 3
    )
    select doc_id, license, max(dice)::double as dice, count(*) as units from scored where dice >= 0.8 group by doc_id, license
    """


@query("op8_license_scan", _licenses_sql())
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf_dir, "documents"))


@query("op3_training_order")
def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.materialise(table(spark, sf_dir, "documents"), key=20_240_229).drop("ids")


@query("op7_repeated_passages")
def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"))


@query("op11_tokenizer_alignment")
def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokenizers(table(spark, sf_dir, "documents"))


@query("op12_simhash_near_dedup")
def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_fingerprints(table(spark, sf_dir, "documents"), n=4, radius=4)


def _codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Rounds of assignment and means, spelled out; every step is exact in whole numbers."""
    near = """
    {step}assigned as (
        select row, position, x, entry, distance from (
            select p.row, p.position, p.x, b.entry, list_sum(list_transform(list_zip(p.x, b.x),
                lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as distance
            from parts p join {step}book b on p.position = b.position)
        qualify row_number() over (partition by row, position order by distance, entry) = 1
    )"""
    mean = """
    {to}book as (
        select b.position, b.entry, coalesce(m.x, b.x) as x from {step}book b left join (
            select position, entry, list((total - ((total % n) + n) % n) // n order by k) as x from (
                select position, entry, k, sum(x[k])::bigint as total, count(*)::bigint as n
                from {step}assigned, range(1, (select max(len(x)) + 1 from parts)) r(k) group by position, entry, k)
            group by position, entry) m on b.position = m.position and b.entry = m.entry
    )"""
    steps = [part.format(step=f"s{r}", to=f"s{r + 1}") for r in range(rounds) for part in (near, mean)]
    last = f"s{rounds}"
    return f"""
    with kept as (
        select row_number() over () as row, vec_id, label,
            list_transform(embedding, lambda c: floor(256 * c::double)::bigint) as v
        from embeddings where len(embedding) > 0
            and len(list_filter(embedding, lambda c: c is not null and isfinite(c))) = len(embedding)
    ), parts as (
        select row, vec_id, position, v[position * (len(v) // {parts}) + 1:(position + 1) * (len(v) // {parts})] as x
        from kept, range({parts}) p(position)
    ), s0book as (
        select position, row_number() over (partition by position order by vec_id) - 1 as entry, x
        from parts qualify entry < {entries}
    ), {", ".join(steps)}, {near.format(step=last)}, coded as (
        select row, string_agg(lpad(format('{{:x}}', entry), 2, '0'), '' order by position) as code,
            sum(distance)::bigint as error
        from {last}assigned group by row
    ), book as (
        select sha256(string_agg(array_to_string(x, ','), ',' order by position, entry)) as codebooks_sha256 from {last}book
    )
    select k.vec_id, c.code, c.error, (sum(c.error) over (partition by k.label))::bigint as label_error, b.codebooks_sha256
    from kept k join coded c on k.row = c.row cross join book b
    """


@query("op13_vector_codes", _codes_sql())
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.compressed(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)
