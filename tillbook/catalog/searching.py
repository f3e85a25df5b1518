"""Search: tokens, index, ranking, structured filters."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tillbook.catalog import query
from tillbook.operators import search as s
from tillbook.operators.search import SearchQuery
from tillbook.session import shared_dir
from tillbook.sources import star

TOKENS = r"list_filter(regexp_split_to_array(strip_accents(lower(coalesce({0}, ''))), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def _count(lists: list[str], words: list[str], prefix: bool) -> str:
    """Occurrences of a term over token lists, in DuckDB."""

    def one(column: str) -> str:
        tests = []
        for k, w in enumerate(words):
            at = f"{column}[i + {k}]"
            tests.append(f"starts_with({at}, '{w}')" if prefix and k == len(words) - 1 else f"{at} = '{w}'")
        return f"len(list_filter(range(1, len({column}) + 1), lambda i: {' and '.join(tests)}))"

    return " + ".join(one(c) for c in lists)


def bm25_cte(name: str, source: str, key: str, columns: list[str], terms: list[tuple[list[str], bool]]) -> str:
    lists = [f"l{i}" for i in range(len(columns))]
    tokens = ", ".join(f"{TOKENS.format(c)} {l}" for c, l in zip(columns, lists))
    length = " + ".join(f"len({l})" for l in lists)
    counts = ", ".join(f"{_count(lists, w, p)} f{i}" for i, (w, p) in enumerate(terms))
    dfs = ", ".join(f"cast(count(*) filter (where f{i} > 0) as double) df{i}" for i in range(len(terms)))
    score = " ".join(
        f"- case when ln((n - df{i} + 0.5) / (df{i} + 0.5)) > 0 then ln((n - df{i} + 0.5) / (df{i} + 0.5)) else 1e-6 end * (f{i} * 2.2) / (f{i} + 1.2 * (0.25 + 0.75 * len / al))"
        for i in range(len(terms)))
    every = " and ".join(f"f{i} > 0" for i in range(len(terms)))
    return f"""{name}_t as materialized (select {key} as key, {tokens} from {source}),
      {name}_c as materialized (select key, {length} len, {counts} from {name}_t),
      {name}_s as (select cast(count(*) as double) n, avg(len) al, {dfs} from {name}_c),
      {name} as materialized (select key, 0 {score} score from {name}_c, {name}_s where {every})"""


def fused_sql(terms, select: str, live: bool = True) -> str:
    """The whole ranking in DuckDB; ``select`` ends the statement over ``hits``."""
    gate = "join item i on i.id = {0} and i.trashed_at is null" if live else "join item i on i.id = {0}"
    return f"""with {bm25_cte('fs', 'item_search_src', 'id', s.FIELD_COLUMNS, terms)},
      {bm25_cte('ps', 'page', 'id', ['ocr_text'], terms)},
      fi as (select key item_id, score from fs {gate.format('key')}),
      pi as (select p.item_id, min(score) score from ps join page p on p.id = key {gate.format('p.item_id')} group by 1),
      fn as (select item_id, case when max(score) over () = min(score) over () then 1 else (max(score) over () - score) / (max(score) over () - min(score) over ()) end v from fi),
      pn as (select item_id, case when max(score) over () = min(score) over () then 1 else (max(score) over () - score) / (max(score) over () - min(score) over ()) end v from pi),
      hits as (select coalesce(fn.item_id, pn.item_id) item_id, round(coalesce(fn.v, 0) + 0.35 * coalesce(pn.v, 0) + case when fn.item_id is not null then 1 else 0 end, 6) score,
        fn.item_id is not null in_fields, pn.item_id is not null in_text from fn full join pn using (item_id))
      {select}"""


def _rounded(df):
    return df.withColumn("score", F.round("score", 6))


@query("text_tokens", f"select id, len(l) n, array_to_string(l, ' ') tokens from (select id, {TOKENS.format('ocr_text')} l from page)")
def text_tokens(spark, sf):
    """Splits leave pages as they are, so the split receipts need not be built for them."""
    page = star.base_library(spark, sf)["page"]
    t = s.tokens_of(F.col("ocr_text"))
    return page.select("id", F.size(t).alias("n"), F.array_join(t, " ").alias("tokens"))


def _documents(spark, sf):
    return star.read_spread(spark, sf, "documents").select("doc_id", "text", "source")


@query("inverted_index", f"""
    with l as (select doc_id, 'text' as "column", {TOKENS.format('text')} l from documents union all select doc_id, 'source', {TOKENS.format('source')} from documents),
    e as (select doc_id, "column", unnest(l) term, generate_subscripts(l, 1) - 1 pos from l)
    select doc_id, "column", term, count(*) tf, min(pos) first_pos from e group by 1, 2, 3""")
def inverted_index(spark, sf):
    """T2"""
    return s.inverted_index(_documents(spark, sf), "doc_id", ["text", "source"])


@query("term_frequencies", f"select term, count(*) df from (select distinct doc_id, unnest({TOKENS.format('text')}) term from documents) group by 1")
def term_frequencies(spark, sf):
    return s.term_stats(s.inverted_index(_documents(spark, sf), "doc_id", ["text"]), "doc_id")


@query("index_audit", f"""
    with e as (select doc_id, unnest({TOKENS.format('text')}) term, generate_subscripts({TOKENS.format('text')}, 1) - 1 pos from documents where doc_id % 50 = 0)
    select doc_id, 'text' as "column", term, count(*) tf, min(pos) first_pos, 'missing' problem from e group by all""")
def index_audit(spark, sf):
    """An index without every fiftieth document."""
    docs = _documents(spark, sf)
    stored = s.inverted_index(docs.filter("doc_id % 50 <> 0"), "doc_id", ["text"])
    return s.index_differences(stored, docs, "doc_id", ["text"])


@query("bm25_pages", f"with {bm25_cte('ps', 'page', 'id', ['ocr_text'], [(['the'], False), (['th'], True)])} select key id, round(score, 6) score from ps")
def bm25_pages(spark, sf):
    """A word and a prefix, both must occur."""
    terms = s.query_tokens(s.clean_query("the th*"))
    return _rounded(s.bm25_rows(star.library(spark, sf)["page"], "id", ["ocr_text"], terms))


@query("bm25_phrase", f"with {bm25_cte('ps', 'page', 'id', ['ocr_text'], [(['of', 'the'], False)])} select key id, round(score, 6) score from ps")
def bm25_phrase(spark, sf):
    """A term of two tokens is a phrase."""
    terms = s.query_tokens(s.clean_query("of-the"))
    return _rounded(s.bm25_rows(star.library(spark, sf)["page"], "id", ["ocr_text"], terms))


def _index(spark, docs, key: str, columns: list[str]) -> str:
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    s.write_index(docs, key, columns, path)
    return path


@query("bm25_indexed_pages", f"with {bm25_cte('ps', 'page', 'id', ['ocr_text'], [(['the'], False), (['th'], True)])} select key id, round(score, 6) score from ps")
def bm25_indexed_pages(spark, sf):
    """T2-T4 from stored postings: a word and a prefix."""
    page = star.library(spark, sf)["page"]
    terms = s.query_tokens(s.clean_query("the th*"))
    return _rounded(s.bm25_indexed(page, "id", ["ocr_text"], terms, _index(spark, page, "id", ["ocr_text"])))


@query("bm25_indexed_phrase", f"with {bm25_cte('ps', 'item_search_src', 'id', s.FIELD_COLUMNS, [(['trading', 'store'], False), (['7'], False)])} select key id, round(score, 6) score from ps")
def bm25_indexed_phrase(spark, sf):
    """T3 from stored postings: a phrase and a word over several columns."""
    rows = star.library(spark, sf)["item_search_src"]
    terms = s.query_tokens(s.clean_query("trading-store 7"))
    return _rounded(s.bm25_indexed(rows, "id", s.FIELD_COLUMNS, terms, _index(spark, rows, "id", s.FIELD_COLUMNS)))


@query("search_both_sides", fused_sql([(["en"], False)], "select item_id, i.type, i.folder_id, score, in_fields, in_text from hits join item i on i.id = item_id where i.trashed_at is null"))
def search_both_sides(spark, sf):
    """Every hit of a word that is a language tag and a word of the texts."""
    return _rounded(s.matches(star.library(spark, sf), SearchQuery(q="en"))).drop("page_id", "snippet")


@query("search_indexed", fused_sql([(["en"], False)], "select item_id, i.type, i.folder_id, score, in_fields, in_text from hits join item i on i.id = item_id where i.trashed_at is null"))
def search_indexed(spark, sf):
    """T6 from stored postings of both sides."""
    lib = star.library(spark, sf)
    index = s.index_library(lib, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
    return _rounded(s.matches(lib, SearchQuery(q="en"), index)).drop("page_id", "snippet")


@query("search_top", fused_sql([(["trading"], False), (["store"], False)], """
    select item_id, i.type, i.folder_id, score, in_fields, in_text from hits join item i on i.id = item_id
    join receipt_data r using (item_id) where i.trashed_at is null and reviewed_at is not null and total_minor >= 10000000 and txn_date <= date '1999-12-31' order by score desc, item_id limit 40 offset 5"""))
def search_top(spark, sf):
    """Scores before filters, then one page."""
    q = SearchQuery(q='"trading" store', reviewed=True, amount_min=10_000_000, date_to="1999-12-31", limit=40, offset=5)
    return _rounded(s.search(star.library(spark, sf), q)).drop("page_id", "snippet")


@query("search_with_trash", fused_sql([(["src1"], True)], "select item_id, i.type, i.folder_id, score, in_fields, in_text from hits join item i on i.id = item_id", live=False))
def search_with_trash(spark, sf):
    """T5 lifted."""
    return _rounded(s.matches(star.library(spark, sf), SearchQuery(q="src1*", include_trashed=True))).drop("page_id", "snippet")


@query("search_structured", """
    select i.id item_id, type, i.folder_id, 0 score, false in_fields, false in_text from item i join v_missing m on m.item_id = i.id join receipt_data r on r.item_id = i.id
    where i.trashed_at is null and missing_total and missing_category and i.folder_id in (select folder_id from subtree_2) order by 1 limit 1000""")
def search_structured(spark, sf):
    """No text, score 0, by id."""
    q = SearchQuery(missing=["total", "category"], folder_id=2, include_subfolders=True, limit=1000)
    return s.search(star.library(spark, sf), q).drop("page_id", "snippet")


@query("search_missing_fields", """
    with f as (select 'category' as field, item_id from v_missing where missing_category union all select 'vendor', item_id from v_missing where missing_vendor)
    select field, item_id from f join item i on i.id = item_id where i.trashed_at is null""")
def search_missing_fields(spark, sf):
    """One missing-filter per field, two tracked and one that nobody tracks, which adds nothing."""
    lib = star.library(spark, sf)
    found = [
        s.structured_filter(lib, SearchQuery(missing=[name])).select(F.lit(name).alias("field"), "item_id")
        for name in ("category", "paymentType", "vendor")
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("search_page", fused_sql([(["en"], False)], r"""
    , shown as (select item_id, score, in_fields, in_text from hits join item i on i.id = item_id where i.trashed_at is null order by score desc, item_id limit 30 offset 10),
      best as (select p.item_id, min_by(p.id, (score, p.id)) page_id from ps join page p on p.id = key group by 1),
      t as (select item_id, regexp_extract_all(ocr_text, '[\p{L}\p{N}][\p{L}\p{N}\p{M}]*') l, string_split_regex(ocr_text, '[\p{L}\p{N}][\p{L}\p{N}\p{M}]*') g from shown join best using (item_id) join page p on p.id = page_id where in_text),
      h as (select *, list_position(list_transform(l, lambda x: strip_accents(lower(x))), 'en') hit_at from t),
      w as (select *, greatest(1, least(hit_at - 4, len(l) - 9)) st from h)
    select s.item_id, score, in_fields, in_text, case when st > 1 then '…' else '' end
      || array_to_string(list_transform(range(st, least(st + 9, len(l)) + 1), lambda i: l[i] || case when i < least(st + 9, len(l)) then g[i + 1] else '' end), '')
      || case when st + 10 <= len(l) then '…' else '' end snippet from shown s left join w using (item_id)"""))
def search_page(spark, sf):
    """One page of hits with their snippets, cut from the texts of these hits alone."""
    return _rounded(s.search(star.library(spark, sf), SearchQuery(q="en", limit=30, offset=10))).drop("type", "folder_id")


@query("search_totals_indexed", fused_sql([(["en"], False)], "select count(*) total, true truncated from hits join item i on i.id = item_id where i.trashed_at is null"))
def search_totals_indexed(spark, sf):
    """X3 from stored postings."""
    lib = star.library(spark, sf)
    index = s.index_library(lib, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
    return s.search_totals(lib, SearchQuery(q="en", limit=10), index)


def _edited(spark, sf):
    """An index of all documents, then two loads: texts written anew, rows deleted and added, some of them again."""
    k = F.col("doc_id")
    docs = star.read(spark, sf, "documents").select("doc_id", "text", "source")
    path = _index(spark, docs, "doc_id", ["text", "source"])
    anew = docs.filter(k % 10 == 3).withColumn("text", F.concat(F.lit("the late edition "), F.coalesce(F.substring("text", 1, 200), F.lit(""))))
    added = docs.filter(k % 10 == 6).withColumn("doc_id", k + 1_000_000)
    s.update_index(anew.unionByName(added), "doc_id", ["text", "source"], path, 1, docs.filter(k % 10 == 4))
    again = docs.filter(k % 20 == 3).withColumn("text", F.lit("second edition of the text"))
    back = docs.filter(k % 20 == 4)
    s.update_index(again.unionByName(back), "doc_id", ["text", "source"], path, 2, added.select("doc_id").filter(k % 20 == 6).unionByName(docs.select((k + 5_000_000).alias("doc_id"))))
    last = docs.filter((k % 10 != 3) & (k % 20 != 14)).unionByName(anew.filter(k % 20 != 3)).unionByName(again).unionByName(added.filter(k % 20 != 6))
    return path, last


EDITED = """edited as (
    select doc_id id, source, case when doc_id % 20 = 3 then 'second edition of the text' when doc_id % 10 = 3 then 'the late edition ' || substr(text, 1, 200) else text end as text
    from documents where doc_id % 20 <> 14 union all select doc_id + 1000000, source, text from documents where doc_id % 10 = 6 and (doc_id + 1000000) % 20 <> 6)"""


def _edited_sql(terms) -> str:
    return f"with {EDITED}, {bm25_cte('ps', 'edited', 'id', ['text', 'source'], terms)} select key doc_id, round(score, 6) score from ps"


@query("index_upkeep", _edited_sql([(["edition"], False), (["the"], True)]))
def index_upkeep(spark, sf):
    """Search after edits, deletes and additions, without a rebuild."""
    path, last = _edited(spark, sf)
    return _rounded(s.bm25_indexed(last, "doc_id", ["text", "source"], s.query_tokens(s.clean_query("edition the*")), path))


@query("index_upkeep_phrase", _edited_sql([(["of", "the"], False)]))
def index_upkeep_phrase(spark, sf):
    """A phrase after the loads have been compacted."""
    path, last = _edited(spark, sf)
    s.compact_index(spark, path, f"{path}-compact")
    return _rounded(s.bm25_indexed(last, "doc_id", ["text", "source"], s.query_tokens(s.clean_query("of-the")), f"{path}-compact"))


@query("stored_index_audit", f"""
    with {EDITED}, e as (select id as key, unnest(list_concat({TOKENS.format('text')}, {TOKENS.format('source')})) term,
        len({TOKENS.format('text')}) + len({TOKENS.format('source')}) len from edited where id % 50 = 7),
    g as (select key, unnest(['ghost', 'words']) term, 2 as len from (select distinct id as key from edited where id % 50 = 8))
    select term, key, count(*) tf, any_value(len) len, 'missing' problem from e group by 1, 2 union all select term, key, 1, len, 'extra' from g
    union all select term, key, count(*), any_value(len), 'missing' from (select id as key, unnest(list_concat({TOKENS.format('text')}, {TOKENS.format('source')})) term,
        len({TOKENS.format('text')}) + len({TOKENS.format('source')}) len from edited where id % 50 = 8) group by 1, 2""")
def stored_index_audit(spark, sf):
    """A stored index that a load has made wrong: rows of it gone, others with words that no text has."""
    path, last = _edited(spark, sf)
    wrong = last.filter("doc_id % 50 = 8").withColumns({"text": F.lit("ghost words"), "source": F.lit(None).cast("string")})
    s.update_index(wrong, "doc_id", ["text", "source"], path, 3, last.filter("doc_id % 50 = 7"))
    return s.index_audit(last, "doc_id", ["text", "source"], path)


@query("index_in_step", "select 0 problems")
def index_in_step(spark, sf):
    """After upkeep and compaction the index is what a fresh one would be."""
    path, last = _edited(spark, sf)
    s.compact_index(spark, path, f"{path}-compact")
    found = s.index_audit(last, "doc_id", ["text", "source"], path).unionByName(s.index_audit(last, "doc_id", ["text", "source"], f"{path}-compact"))
    return found.agg(F.count("*").alias("problems"))


@query("search_totals", """
    select count(*) total, 0 + 50 < count(*) truncated from item i join receipt_data r on r.item_id = i.id
    where i.trashed_at is null and vendor_id = 5 and tax_category_id = 1""")
def search_totals(spark, sf):
    """X3"""
    return s.search_totals(star.library(spark, sf), SearchQuery(vendor_id=5, tax_category_id=1))


@query("accented_words", "with t as (select doc_id, lang, " + TOKENS.format('text') + """ l from documents)
    select 'für' word, doc_id from t where list_contains(l, 'fur') union all select 'réeaux', doc_id from t where list_contains(l, 'reeaux')
    union all select 'ÇIÓN', doc_id from t where list_contains(l, 'cion') union all select 'the', doc_id from t where list_contains(l, 'the')""")
def accented_words(spark, sf):
    """A word of each language, with its marks, finds the texts that hold it."""
    return _found(_documents(spark, sf), "text", ["für", "réeaux", "ÇIÓN", "the"])


@query("other_scripts", """
    select 'Йогурт' word, doc_id from documents where lang = 'de' union all select '한국', doc_id from documents where lang = 'fr'
    union all select 'ガム', doc_id from documents where lang = 'es'""")
def other_scripts(spark, sf):
    """Words in scripts whose letters decompose, too, but are no Latin letters with marks."""
    lang = F.col("lang")
    word = F.when(lang == "de", "ЙОГУРТ").when(lang == "fr", "한국").when(lang == "es", "ガム").otherwise("")
    docs = star.read_spread(spark, sf, "documents").select("doc_id", F.concat(F.lit("x "), word, F.lit(". "), "text").alias("text"))
    return _found(docs, "text", ["Йогурт", "한국", "ガム"])


def _found(docs, column: str, words: list[str]):
    parts = [
        s.bm25_rows(docs, "doc_id", [column], s.query_tokens(s.clean_query(w))).select(F.lit(w).alias("word"), "doc_id") for w in words
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("search_snippets", r"""
    with t as (select id, regexp_extract_all(ocr_text, '[\p{L}\p{N}][\p{L}\p{N}\p{M}]*') l, string_split_regex(ocr_text, '[\p{L}\p{N}][\p{L}\p{N}\p{M}]*') g from page),
    h as (select *, list_position(list_transform(l, lambda x: strip_accents(lower(x))), 'the') hit_at from t),
    w as (select *, greatest(1, least(hit_at - 4, len(l) - 9)) st from h where hit_at > 0)
    select id, case when st > 1 then '…' else '' end
      || array_to_string(list_transform(range(st, least(st + 9, len(l)) + 1), lambda i: l[i] || case when i < least(st + 9, len(l)) then g[i + 1] else '' end), '')
      || case when st + 10 <= len(l) then '…' else '' end snippet from w""")
def search_snippets(spark, sf):
    """T8"""
    page = star.library(spark, sf)["page"]
    rows = s.bm25_rows(page, "id", ["ocr_text"], [(["the"], False)]).join(page.select("id", "ocr_text"), "id")
    return rows.select("id", s.snippet(F.col("ocr_text"), ["the"], False).alias("snippet"))
