"""Ranked search over two text sides, item fields and page text."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillbook.functions.let import let
from tillbook.operators.canonical import missing_key_data
from tillbook.operators.listing import in_folder
from tillbook.schemas import Library
from tillbook.session import checkpointed

# --- fixed values --------------------------------------------------------------------
BM25_K1, BM25_B, MIN_IDF = 1.2, 0.75, 1e-6
FIELD_WEIGHT, PAGE_WEIGHT, FIELD_BONUS = 1.0, 0.35, 1.0
SEARCH_LIMIT, SNIPPET_TOKENS = 50, 10
FIELD_COLUMNS = ["vendor", "description", "notes", "title", "org"]
MISSING_COLUMNS = {
    "vendor": "missing_vendor",
    "txnDate": "missing_date",
    "total": "missing_total",
    "category": "missing_category",
    "taxCategory": "missing_tax_category",
}
# Latin letters with diacritics, from the rule that they decompose to a letter and marks.
_LATIN = [chr(c) for c in (*range(0x00E0, 0x0250), *range(0x1E00, 0x1F00))]
_LATIN = [c for c in _LATIN if c == c.lower() and len(d := unicodedata.normalize("NFD", c)) > 1 and d[0].isascii()]
MARKED, PLAIN = "".join(_LATIN), "".join(unicodedata.normalize("NFD", c)[0] for c in _LATIN)


class SearchQueryError(ValueError):
    """The free text cannot be searched for; the message says why."""


@dataclass(frozen=True)
class SearchQuery:
    q: str = ""
    folder_id: int | None = None
    include_subfolders: bool = False
    type: str | None = None
    reviewed: bool | None = None
    vendor_id: int | None = None
    category_id: int | None = None
    tax_category_id: int | None = None
    project_id: int | None = None
    date_from: str | None = None
    date_to: str | None = None
    amount_min: int | None = None
    amount_max: int | None = None
    missing: list[str] = field(default_factory=list)
    include_trashed: bool = False
    exclude_superseded: bool = False
    limit: int = SEARCH_LIMIT
    offset: int = 0


# --- query text ----------------------------------------------------------------------


def clean_query(text: str) -> list[tuple[str, bool]]:
    """(term, is prefix) list; all terms must match.  Runs on one query string."""
    terms = []
    for raw in text.split():
        if raw.startswith("*"):
            raise SearchQueryError("Leading wildcards are not allowed; use a trailing * for prefix match")
        prefix = raw.endswith("*")
        core = raw[:-1] if prefix else raw
        if len(core) >= 2 and core[0] == core[-1] == '"':
            core = core[1:-1]
        if core.replace('"', ""):
            terms.append((core, prefix))
    return terms


def query_tokens(terms: list[tuple[str, bool]]) -> list[tuple[list[str], bool]]:
    """Each term as its tokens; a term of several tokens is a phrase."""
    fold = str.maketrans(MARKED, PLAIN)
    out = []
    for term, prefix in terms:
        # The same fold as ``folded_text``: what is indexed and what is asked for must agree in every script.
        folded = "".join(c for c in term.lower().translate(fold) if not unicodedata.category(c).startswith("M"))
        tokens = [t for t in re.split(r"[\W_]+", folded) if t]
        if tokens:
            out.append((tokens, prefix))
    return out


# --- text ----------------------------------------------------------------------------


def folded_text(text: Column) -> Column:
    """Lower case without diacritics; plain ASCII needs only the former."""
    low = F.lower(text)
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(low, MARKED, PLAIN), r"\p{M}+", "")).otherwise(low)


def tokens_of(text: Column) -> Column:
    """Letters and digits, in order; null text has none."""
    return F.filter(F.split(F.coalesce(folded_text(text), F.lit("")), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def inverted_index(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Postings (key, column, term, positions count, first position).

    The group is (document, column, term): a term that half of all documents use is spread
    over all of them, and repeats within a document are combined before the shuffle.
    """
    sides = F.array(*[F.struct(F.lit(c).alias("column"), tokens_of(F.col(c)).alias("tokens")) for c in columns])
    rows = docs.select(key, F.explode(sides).alias("s")).select(key, "s.column", F.posexplode("s.tokens").alias("pos", "term"))
    return rows.groupBy(key, "column", "term").agg(F.count("*").alias("tf"), F.min("pos").alias("first_pos"))


def term_stats(index: DataFrame, key: str) -> DataFrame:
    """Document frequency per term, from pre-counted postings."""
    return index.select(key, "term").distinct().groupBy("term").agg(F.count("*").alias("df"))


# --- matching ------------------------------------------------------------------------


def term_pattern(words: list[str], prefix: bool) -> str:
    """Pattern of a term in folded text: whole words, a phrase across separators, the last word open if a prefix.

    Only the first word is consumed, so overlapping phrases all count.
    """
    letter = r"[\p{L}\p{N}]"
    end = "" if prefix else f"(?!{letter})"
    gap = r"[^\p{L}\p{N}]+"
    if len(words) == 1:
        return f"(?<!{letter}){words[0]}{end}"
    rest = gap.join(words[1:])
    return f"(?<!{letter}){words[0]}(?={gap}{rest}{end})"


WORD = r"[\p{L}\p{N}]+"
# A word of text as it is: marks that folding drops stand after their letters.
TOKEN = r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*"


def bm25_rows(docs: DataFrame, key: str, columns: list[str], terms: list[tuple[list[str], bool]]) -> DataFrame:
    """(key, score) of the rows that hold every term; lower is better.

    One scan turns each document into its length and term counts, by pattern, without cutting it into tokens; these
    numbers are kept, as they are asked for several times.  Corpus size, mean length and document frequencies are one
    aggregate row, read back as scalars: no token is ever shuffled.  Statistics cover all rows given, matching or not.
    Texts are read once more only where the caller uses them.
    """
    sides = [f"_t{i}" for i in range(len(columns))]
    texts = docs.select(key, *[F.coalesce(folded_text(F.col(c)), F.lit("")).alias(s) for c, s in zip(columns, sides)])
    total = lambda pattern: sum((F.regexp_count(s, F.lit(pattern)) for s in sides[1:]), F.regexp_count(sides[0], F.lit(pattern)))
    counted = checkpointed(texts.select(
        key, total(WORD).alias("len"),
        *[total(term_pattern(words, prefix)).alias(f"f{i}") for i, (words, prefix) in enumerate(terms)],
    ))
    stats = counted.agg(
        F.count("*").cast("double").alias("n"),
        F.avg("len").alias("avg_len"),
        *[F.count_if(F.col(f"f{i}") > 0).cast("double").alias(f"df{i}") for i in range(len(terms))],
    )
    stat = stats.select(F.struct("*").alias("s")).scalar()
    matching = counted
    for i in range(len(terms)):
        matching = matching.filter(F.col(f"f{i}") > 0)
    return matching.withColumn("_s", stat).select(key, _score(len(terms)).alias("score"))


def _score(terms: int) -> Column:
    """Lower is better; from ``len``, the counts f0.. and the statistics ``_s`` (n, avg_len, df0..)."""
    n, avg = F.col("_s.n"), F.col("_s.avg_len")
    score = F.lit(0.0)
    for i in range(terms):
        df, f = F.col(f"_s.df{i}"), F.col(f"f{i}").cast("double")
        raw = F.log((n - df + 0.5) / (df + 0.5))
        idf = F.when(raw > 0, raw).otherwise(MIN_IDF)
        norm = F.lit(BM25_K1) * (F.lit(1 - BM25_B) + F.lit(BM25_B) * F.col("len") / avg)
        score = score - idf * (f * (BM25_K1 + 1)) / (f + norm)
    return score


# --- stored postings -------------------------------------------------------------------


POSTINGS = "term string, key bigint, tf bigint, len bigint, load int"
ROWS = "key bigint, len bigint, load int"
TOTALS = "n bigint, words bigint, load int"


def write_index(docs: DataFrame, key: str, columns: list[str], path: str) -> None:
    """A new index: postings sorted by term, so that a request reads the row groups of its terms only, and lengths.

    An index is a folder of loads.  ``postings``: term, key, tf, len (words of the row in all columns); ``rows``: key and
    len of all rows of the load, null for a row that is gone; ``totals``: rows and words that the load adds, one row.
    """
    _write_load(_postings(docs, key, columns), _lengths(docs, key, columns), path, 0)


def _lengths(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    texts = _texts(docs, key, columns)
    return texts.select("key", sum((F.size(tokens_of(F.col(f"_t{i}"))) for i in range(1, len(columns))), F.size(tokens_of(F.col("_t0")))).cast("bigint").alias("len"))


def _by_key(rows: DataFrame) -> DataFrame:
    """All rows of a key in one part, as many parts as a shuffle has: what counts by key behind it shuffles no more."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")


def _texts(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, _t0, _t1 ..: all texts by key, so that cutting them into words is spread however the source is cut into files."""
    return _by_key(docs.select(F.col(key).cast("bigint").alias("key"), *[F.col(c).alias(f"_t{i}") for i, c in enumerate(columns)]))


def _postings(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """term, key, tf, len of every word of every row.  Texts are shuffled by key, not their words, which are many more."""
    texts = _texts(docs, key, columns)
    words = texts.select("key", F.concat(*[tokens_of(F.col(f"_t{i}")) for i in range(len(columns))]).alias("tokens"))
    # Outer, so that no test for empty arrays is pushed below the shuffle and cuts the text a second time.
    words = words.select("key", F.size("tokens").cast("bigint").alias("len"), F.explode_outer("tokens").alias("term")).filter("term IS NOT NULL")
    return words.groupBy("term", "key", "len").agg(F.count("*").alias("tf")).select("term", "key", "tf", "len")


def _write_load(postings: DataFrame, rows: DataFrame, path: str, load: int, replaced: DataFrame | None = None) -> None:
    postings.repartitionByRange("term", "key").sortWithinPartitions("term", "key").write.mode("overwrite").parquet(f"{path}/postings/load={load}")
    rows.write.mode("overwrite").parquet(f"{path}/rows/load={load}")
    written = rows.sparkSession.read.schema("key bigint, len bigint").parquet(f"{path}/rows/load={load}").filter("len IS NOT NULL")
    sums = written.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("words"))
    if replaced is not None:
        gone = replaced.agg(F.struct(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("words")).alias("g")).scalar()
        sums = sums.withColumn("g", gone).select((F.col("n") - F.col("g.n")).alias("n"), (F.col("words") - F.col("g.words")).alias("words"))
    sums.write.mode("overwrite").parquet(f"{path}/totals/load={load}")


def _read(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/{name}")


def _newest(rows: DataFrame) -> DataFrame:
    """key, newest load of it, len there."""
    return rows.groupBy("key").agg(F.max(F.struct("load", "len")).alias("r")).select("key", F.col("r.load").alias("newest"), F.col("r.len").alias("newest_len"))


def update_index(docs: DataFrame, key: str, columns: list[str], path: str, load: int, deleted: DataFrame | None = None) -> None:
    """Rows written anew or for the first time, and keys ``deleted`` (key), as load number ``load`` (1, 2, ...).

    Only the load is cut into words.  The newest load of a row counts; what older ones hold of it is passed over by
    requests until ``compact_index``.  A key both written and deleted is written.  Writing a load again replaces it.
    """
    spark = docs.sparkSession
    written = _lengths(docs, key, columns)
    if deleted is not None:
        gone = deleted.select(F.col(key).cast("bigint").alias("key")).distinct().join(written.select("key"), "key", "left_anti")
        written = written.unionByName(gone.withColumn("len", F.lit(None).cast("bigint")))
    rows = checkpointed(written)
    older = _read(spark, path, "rows", ROWS).filter(F.col("load") < load).join(rows.select("key"), "key", "left_semi")
    replaced = checkpointed(_newest(older).filter("newest_len IS NOT NULL").select("key", F.col("newest_len").alias("len")))
    # A mark for a row that no load has says nothing.
    rows = rows.join(older.select("key"), "key", "left_semi").unionByName(rows.join(older.select("key"), "key", "left_anti").filter("len IS NOT NULL"))
    _write_load(_postings(docs, key, columns), rows, path, load, replaced)


def live_postings(spark: SparkSession, path: str, wanted: Column | None = None) -> DataFrame:
    """Postings of the newest load of each row, of the terms ``wanted``.

    Later loads are small beside the first until they are compacted: only the keys in them are looked at.
    """
    postings = _read(spark, path, "postings", POSTINGS)
    if wanted is not None:
        postings = postings.filter(wanted)
    changed = _newest(_read(spark, path, "rows", ROWS).filter("load > 0")).select("key", "newest")
    return _current(postings, changed)


def _current(postings: DataFrame, changed: DataFrame) -> DataFrame:
    """Without the postings of loads older than the newest of their row."""
    return postings.join(changed, "key", "left").filter(F.col("load") == F.coalesce("newest", F.lit(0))).select("term", "key", "tf", "len")


def compact_index(spark: SparkSession, path: str, into: str) -> None:
    """The same index as a single load in a new folder."""
    newest = _newest(_read(spark, path, "rows", ROWS)).filter("newest_len IS NOT NULL")
    _write_load(live_postings(spark, path), newest.select("key", F.col("newest_len").alias("len")), into, 0)


def bm25_indexed(
    docs: DataFrame, key: str, columns: list[str], terms: list[tuple[list[str], bool]], path: str
) -> DataFrame:
    """T3/T4 from a stored index: the same (key, score) as ``bm25_rows``.

    Only postings of the words asked for are read, and ``docs`` only for phrases, which are counted in the texts of rows
    that hold every word of them.
    """
    spark = docs.sparkSession
    word = F.col("term")
    asked = {(w, prefix and k == len(words) - 1) for words, prefix in terms for k, w in enumerate(words)}
    wanted = F.lit(False)
    for w, open_end in sorted(asked):
        wanted = wanted | (word.startswith(w) if open_end else word == w)
    # Read, freed of older loads and kept once; they are asked for several times.
    postings = checkpointed(live_postings(spark, path, wanted))

    def rows_of(words: list[str], prefix: bool) -> DataFrame:
        """Rows that hold every word of a term, with the counts of a single word."""
        found = None
        for k, w in enumerate(words):
            open_end = prefix and k == len(words) - 1
            one = postings.filter(word.startswith(w) if open_end else word == w).groupBy("key", "len").agg(F.sum("tf").alias("tf"))
            found = one if found is None else found.join(one.select("key"), "key", "left_semi")
        return found

    counted = []
    for i, (words, prefix) in enumerate(terms):
        rows = rows_of(words, prefix)
        if len(words) > 1:
            pattern = F.lit(term_pattern(words, prefix))
            texts = docs.select(F.col(key).alias("key"), *[F.coalesce(folded_text(F.col(c)), F.lit("")).alias(f"_t{j}") for j, c in enumerate(columns)])
            times = sum((F.regexp_count(f"_t{j}", pattern) for j in range(1, len(columns))), F.regexp_count("_t0", pattern))
            rows = checkpointed(rows.join(texts, "key").select("key", "len", times.cast("bigint").alias("tf")).filter("tf > 0"))
        counted.append(rows.withColumnRenamed("tf", f"f{i}"))
    totals = _read(spark, path, "totals", TOTALS).agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    stats = totals.select(F.col("n").cast("double").alias("n"), (F.col("words") / F.col("n")).alias("avg_len"))
    for i, rows in enumerate(counted):
        stats = stats.withColumn(f"df{i}", rows.agg(F.count("*").cast("double").alias("df")).scalar())
    stat = stats.select(F.struct("*").alias("s")).scalar()
    matching = counted[0]
    for rows in counted[1:]:
        matching = matching.join(rows.drop("len"), "key")
    return matching.withColumn("_s", stat).select(F.col("key").alias(key), _score(len(terms)).alias("score"))


def snippet(text: Column, words: list[str], prefix: bool) -> Column:
    """About ten tokens around the first occurrence of the first term, as the text itself has them."""
    gaps = F.split(text, TOKEN)

    def cut(t: Column) -> Column:
        hit = lambda x: x.startswith(words[0]) if prefix and len(words) == 1 else x == words[0]
        at = F.array_position(F.transform(t, lambda x: F.when(hit(folded_text(x)), F.lit("y")).otherwise("n")), "y").cast("int")
        start = F.greatest(F.lit(1), F.least(at - 4, F.size(t) - SNIPPET_TOKENS + 1))
        last = F.least(start + SNIPPET_TOKENS - 1, F.size(t))
        # Token i stands between gaps i and i + 1.
        window = F.array_join(
            F.transform(
                F.sequence(start, last),
                lambda i: F.concat(F.element_at(t, i), F.when(i < last, F.element_at(gaps, i + 1)).otherwise("")),
            ),
            "",
        )
        return F.concat(
            F.when(start > 1, "…").otherwise(""),
            window,
            F.when(start + SNIPPET_TOKENS <= F.size(t), "…").otherwise(""),
        )

    return let(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), cut)


def normalised(side: DataFrame, score: str, out: str) -> DataFrame:
    """1 = best of the side, over everything the side matched; a single score or no span is 1."""
    span = side.agg(F.struct(F.min(score).alias("lo"), F.max(score).alias("hi"))).scalar()
    rows = side.withColumn("_m", span)
    lo, hi = F.col("_m.lo"), F.col("_m.hi")
    return rows.withColumn(out, F.when(hi == lo, 1.0).otherwise((hi - F.col(score)) / (hi - lo))).drop("_m")


def index_library(lib: Library, path: str) -> dict[str, str]:
    """Stored postings of both sides, for ``matches``."""
    write_index(lib["item_search_src"], "id", FIELD_COLUMNS, f"{path}/fields")
    write_index(lib["page"].select("id", "ocr_text"), "id", ["ocr_text"], f"{path}/pages")
    return {"fields": f"{path}/fields", "pages": f"{path}/pages"}


def _ranked(docs: DataFrame, columns: list[str], terms: list[tuple[list[str], bool]], index: str | None) -> DataFrame:
    return bm25_indexed(docs, "id", columns, terms, index) if index else bm25_rows(docs, "id", columns, terms)


def item_side(lib: Library, terms: list[tuple[list[str], bool]], include_trashed: bool, index: str | None = None) -> DataFrame:
    """Items whose fields match: item_id, score."""
    hits = _ranked(lib["item_search_src"], FIELD_COLUMNS, terms, index).select(F.col("id").alias("item_id"), "score")
    return hits if include_trashed else hits.join(live_items(lib), "item_id", "left_semi")


def page_side(lib: Library, terms: list[tuple[list[str], bool]], include_trashed: bool, index: str | None = None) -> DataFrame:
    """Items by their best page: item_id, score, page_id."""
    owner = lib["page"].select("id", "item_id")
    hits = _ranked(lib["page"].select("id", "ocr_text"), ["ocr_text"], terms, index).join(owner, "id")
    if not include_trashed:
        hits = hits.join(live_items(lib), "item_id", "left_semi")
    return hits.groupBy("item_id").agg(F.min(F.struct("score", "id")).alias("b")).select("item_id", "b.score", F.col("b.id").alias("page_id"))


def live_items(lib: Library) -> DataFrame:
    """T5: search only sees live items unless asked otherwise."""
    return lib["item"].filter("trashed_at IS NULL").select(F.col("id").alias("item_id"))


def fused(
    lib: Library, terms: list[tuple[list[str], bool]], include_trashed: bool, index: dict[str, str] | None = None
) -> DataFrame:
    """Both sides in one ranking; a field match outranks any page match.  No text goes through it."""
    index = index or {}
    # A side is a few numbers per hit; its span and its rows come from one evaluation.
    fields = normalised(checkpointed(item_side(lib, terms, include_trashed, index.get("fields"))), "score", "field_norm").drop("score")
    pages = normalised(checkpointed(page_side(lib, terms, include_trashed, index.get("pages"))), "score", "page_norm").drop("score")
    both = fields.join(pages, "item_id", "full")
    in_fields = F.col("field_norm").isNotNull()
    score = (
        F.coalesce("field_norm", F.lit(0.0)) * FIELD_WEIGHT
        + F.coalesce("page_norm", F.lit(0.0)) * PAGE_WEIGHT
        + F.when(in_fields, FIELD_BONUS).otherwise(0.0)
    )
    return both.select(
        "item_id", score.alias("score"), in_fields.alias("in_fields"), F.col("page_norm").isNotNull().alias("in_text"), "page_id"
    )


# --- structured filter ---------------------------------------------------------------


def structured_filter(lib: Library, query: SearchQuery) -> DataFrame:
    """Items (item_id, type, folder_id) that satisfy everything but the free text."""
    rows = lib["item"].withColumnRenamed("id", "item_id")
    if not query.include_trashed:
        rows = rows.filter("trashed_at IS NULL")
    if query.exclude_superseded:
        rows = rows.filter("superseded_at IS NULL")
    if query.type:
        rows = rows.filter(F.col("type") == query.type)
    if query.reviewed is not None:
        rows = rows.filter(F.col("reviewed_at").isNotNull() == F.lit(query.reviewed))
    rows = in_folder(lib, rows.select("item_id", "type", "folder_id"), query.folder_id, query.include_subfolders)
    c = F.col
    limits = [
        (query.vendor_id, lambda v: c("vendor_id") == v),
        (query.category_id, lambda v: c("category_id") == v),
        (query.tax_category_id, lambda v: c("tax_category_id") == v),
        (query.project_id, lambda v: c("project_id") == v),
        (query.date_from, lambda v: c("txn_date") >= F.lit(v).cast("date")),
        (query.date_to, lambda v: c("txn_date") <= F.lit(v).cast("date")),
        (query.amount_min, lambda v: c("total_minor") >= v),
        (query.amount_max, lambda v: c("total_minor") <= v),
    ]
    wanted = [test(v) for v, test in limits if v is not None]
    if wanted:
        receipts = lib["receipt_data"]
        for test in wanted:
            receipts = receipts.filter(test)
        rows = rows.join(receipts.select("item_id"), "item_id", "left_semi")
    if query.missing:
        flags = missing_key_data(lib)
        for name in query.missing:
            flags = flags.filter(F.col(MISSING_COLUMNS[name]) if name in MISSING_COLUMNS else F.lit(False))
        rows = rows.join(flags.select("item_id"), "item_id", "left_semi")
    return rows.select("item_id", "type", "folder_id")


def matches(lib: Library, query: SearchQuery, index: dict[str, str] | None = None) -> DataFrame:
    """All hits of a query before paging, with the page that a hit in the text is on; from the postings of
    ``index_library`` where they are given, else by a scan."""
    terms = query_tokens(clean_query(query.q))
    allowed = structured_filter(lib, query)
    if not clean_query(query.q):
        return allowed.select(
            "item_id", "type", "folder_id", F.lit(0.0).alias("score"), F.lit(False).alias("in_fields"),
            F.lit(False).alias("in_text"), F.lit(None).cast("bigint").alias("page_id"))
    if not terms:
        # Terms of punctuation alone match nothing.
        return allowed.filter(F.lit(False)).select(
            "item_id", "type", "folder_id", F.lit(0.0).alias("score"), F.lit(False).alias("in_fields"),
            F.lit(False).alias("in_text"), F.lit(None).cast("bigint").alias("page_id"))
    return fused(lib, terms, query.include_trashed, index).join(allowed, "item_id").select(
        "item_id", "type", "folder_id", "score", "in_fields", "in_text", "page_id")


def search(lib: Library, query: SearchQuery, index: dict[str, str] | None = None) -> DataFrame:
    """One page of hits, best first, with a snippet each.

    Two phases: the ranking is cut to the page first, and only then texts are read, of the hits that are shown.
    """
    best = [F.col("score").desc(), F.col("item_id")]
    shown = matches(lib, query, index).orderBy(*best).offset(query.offset).limit(query.limit)
    terms = query_tokens(clean_query(query.q))
    if not terms:
        return shown.drop("page_id").withColumn("snippet", F.lit(None).cast("string"))
    shown = checkpointed(shown)
    texts = lib["page"].select(F.col("id").alias("page_id"), "ocr_text").join(
        shown.select("page_id").filter("page_id IS NOT NULL"), "page_id", "left_semi")
    cut = texts.select("page_id", snippet(F.col("ocr_text"), *terms[0]).alias("snippet"))
    return shown.join(cut, "page_id", "left").drop("page_id").orderBy(*best)


def search_totals(lib: Library, query: SearchQuery, index: dict[str, str] | None = None) -> DataFrame:
    """Total, and whether the page leaves hits out."""
    total = matches(lib, query, index).agg(F.count("*").alias("total"))
    shown = F.least(F.lit(query.limit), F.greatest(F.lit(0), F.col("total") - query.offset))
    return total.select("total", (F.lit(query.offset) + shown < F.col("total")).alias("truncated"))


def index_audit(docs: DataFrame, key: str, columns: list[str], path: str) -> DataFrame:
    """(term, key, tf, len, problem) of the postings that a stored index has too much or too little."""
    spark = docs.sparkSession
    changed = _newest(_read(spark, path, "rows", ROWS).filter("load > 0")).select("key", "newest")
    stored = _current(_by_key(_read(spark, path, "postings", POSTINGS)), changed)
    fresh = _postings(docs, key, columns)
    mark = lambda rows, problem: rows.select("term", "key", "tf", "len", F.lit(problem).alias("problem"))
    # Both sides lie by key: a posting that both have cancels out where it lies.
    sides = mark(stored, "extra").unionByName(mark(fresh, "missing"))
    same = sides.groupBy("term", "key", "tf", "len").agg(F.count("*").alias("n"), F.min("problem").alias("problem"))
    return same.filter("n = 1").drop("n")


def index_differences(stored: DataFrame, docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Postings that a stored index has too much or too little."""
    fresh = inverted_index(docs, key, columns)
    stored = stored.select(*fresh.columns)
    extra = stored.exceptAll(fresh).withColumn("problem", F.lit("extra"))
    lost = fresh.exceptAll(stored).withColumn("problem", F.lit("missing"))
    return extra.unionByName(lost)
