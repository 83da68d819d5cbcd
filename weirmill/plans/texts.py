"""Queries of text cleaning, chunking and hashing, over whole texts of the corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirmill.operators import textops as X
from weirmill.operators.relational import jaccard
from weirmill.operators.skew import lookup_join
from weirmill.functions.text import words
from weirmill.session import stored
from weirmill.tables import table


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "text")


def _mapped(name: str, change):
    def query(s: SparkSession, d: str) -> DataFrame:
        return _docs(s, d).select("doc_id", F.md5(change(F.col("text"))).alias("digest"))

    query.__name__ = name
    return query


def txt_stats(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", F.inline(F.array(X.text_stats(F.col("text")))))


def txt_embedding(s: SparkSession, d: str) -> DataFrame:
    return X.for_embedding(_docs(s, d), "text").select("doc_id", F.md5("text").alias("digest"))


def chk_fixed(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", F.inline(X.fixed_chunks(F.col("text"))))


def chk_words(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", F.inline(X.word_windows(F.col("text"))))


def chk_sentences(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", F.inline(X.split_sentences("text")))


def chk_sentence_pack(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", F.inline(X.sentence_chunker()("text")))


def chk_embedding(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", F.inline(X.sentence_chunker(overlap=200)("text")))


def dup_sha(s: SparkSession, d: str) -> DataFrame:
    hashes = stored(_docs(s, d).select("doc_id", X.content_sha(F.col("text")).alias("sha")), "hashes")
    classes = hashes.groupBy("sha").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n_docs"))
    return lookup_join(hashes, classes, ["sha"]).select("doc_id", "first_doc", "n_docs")


def dup_simhash(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", X.simhash_of(F.col("text")).alias("fingerprint"))


def dup_simhash_links(s: SparkSession, d: str) -> DataFrame:
    return X.simhash_links(stored(dup_simhash(s, d), "fingerprints"), "doc_id", "fingerprint")


def dup_minhash(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "ruvector_docs").select("id", X.minhash_of(F.col("text")).alias("signature"))


def dup_shingles(s: SparkSession, d: str) -> DataFrame:
    grams = _docs(s, d).select("doc_id", F.explode(X.shingles(F.col("text"))).alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))


def dup_url(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "webset_items").groupBy(X.simple_url(F.col("url")).alias("page")).agg(F.min("row_no").alias("first_no"), F.count(F.lit(1)).alias("n_rows"))


def set_jaccard(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "ruvector_docs")
    kids = docs.filter("parent_id is not null").select("id", "parent_id", F.array_distinct(words(F.col("text"))).alias("a"))
    up = docs.select(F.col("id").alias("parent_id"), F.array_distinct(words(F.col("text"))).alias("b"))
    return lookup_join(kids, up, ["parent_id"]).select("id", F.round(jaccard(F.col("a"), F.coalesce("b", F.array().cast("array<string>"))), 6).alias("jaccard"))


_CHANGES = {
    "txt_clean": X.clean, "txt_display": X.for_display, "txt_no_urls": X.no_urls, "txt_no_emails": X.no_emails, "txt_boilerplate": X.no_boilerplate,
    "txt_marks": X.plain_marks, "txt_flat": X.flat, "txt_navigation": X.no_navigation, "txt_paragraphs": X.main_paragraphs, "txt_repeated_lines": X.no_repeated_lines, "txt_short_runs": X.short_runs, "txt_summary": X.summary_words,
}
_FUNCTIONS = (txt_stats, txt_embedding, chk_fixed, chk_words, chk_sentences, chk_sentence_pack, chk_embedding, dup_sha, dup_simhash, dup_simhash_links, dup_minhash, dup_shingles, dup_url, set_jaccard)
QUERIES = {name: _mapped(name, change) for name, change in _CHANGES.items()} | {f.__name__: f for f in _FUNCTIONS}

_W = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_TOK = f"list_filter(str_split_regex({{0}}, '{_W}+'), lambda x: x <> '')".replace("{85}", "{{85}}").replace("{a0}", "{{a0}}").replace("{1680}", "{{1680}}").replace("{2000}", "{{2000}}").replace("{200a}", "{{200a}}").replace("{2028}", "{{2028}}").replace("{2029}", "{{2029}}").replace("{202f}", "{{202f}}").replace("{205f}", "{{205f}}").replace("{3000}", "{{3000}}").format
_STRIP = f"regexp_replace(regexp_replace({{0}}, '^{_W}+', ''), '{_W}+$', '')".replace("\\x{", "\\x{{").replace("{{0}}", "{0}")
for _h in ("85", "a0", "1680", "2000", "200a", "2028", "2029", "202f", "205f", "3000"):
    _STRIP = _STRIP.replace("{{" + _h + "}", "{{" + _h + "}}")
_strip = _STRIP.format


def _digest(expr: str) -> str:
    return f"select doc_id, md5({expr}) as digest from documents"


def _chain(expr: str, patterns, flags: str) -> str:
    for p in patterns:
        expr = f"regexp_replace({expr}, '{p}', '', '{flags}')"
    return expr


_NORMAL = _strip(_chain(f"lower(regexp_replace(text, '{_W}+', ' ', 'g'))", X.FOOTERS, "g"))
ORACLE = {
    "txt_no_urls": _digest(_chain("text", (r"https?://\S+", r"www\.\S+"), "g")),
    "txt_boilerplate": _digest(_chain("text", X.BOILERPLATE, "gi")),
    "txt_marks": _digest("replace(translate(regexp_replace(text, '[\\x{200b}-\\x{200d}\\x{feff}]', '', 'g'), '“”‘’–—―', '\"\"' || chr(39) || chr(39) || '---'), '…', '...')"),
    "txt_flat": _digest(f"regexp_replace(text, '{_W}+', ' ', 'g')"),
    "txt_repeated_lines": _digest("array_to_string(list_transform(list_filter(range(1, len(str_split(text, chr(10))) + 1), lambda i: i = 1 or str_split(text, chr(10))[i - 1] = '' or lower(str_split(text, chr(10))[i]) <> lower(str_split(text, chr(10))[i - 1])), lambda i: str_split(text, chr(10))[i]), chr(10))"),
    "txt_stats": f"""select doc_id, cast(n as int) as n_words, cast(greatest(1, floor(n / 200.0)) as int) as minutes, case when length(text) > 200 then left(text, 200) || '...' else text end as excerpt
        from (select doc_id, text, len({_TOK('lower(text)')}) as n from documents)""",
    "chk_fixed": f"""with t as (select doc_id, {_strip('text')} as t from documents), c as (select doc_id, i as start_pos, {_strip('substr(t, i + 1, 512)')} as piece from (select doc_id, t, unnest(range(0, length(t), 512)) as i from t))
        select doc_id, cast(row_number() over (partition by doc_id order by start_pos) - 1 as int) as no, cast(start_pos as int) as start_pos, piece from c where length(piece) >= 100""",
    "chk_words": f"""with t as (select doc_id, {_TOK('text')} as w from documents), n as (select doc_id, w, unnest(range(0, case when len(w) <= 256 then 1 else cast(1 + ceil((len(w) - 256) / 206.0) as int) end)) as i from t where len(w) > 0)
        select doc_id, cast(i as int) as no, cast(i * 206 as int) as start_word, array_to_string(w[i * 206 + 1:i * 206 + 256], ' ') as piece from n""",
    "dup_sha": f"select doc_id, min(doc_id) over (partition by sha) as first_doc, count(*) over (partition by sha) as n_docs from (select doc_id, sha256({_NORMAL}) as sha from documents)",
    "dup_url": r"""select lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '^www\.', ''), '/+$', ''), '[?&](utm_|ref=|source=)[^&]*', '', 'g')) as page, min(row_no) as first_no, count(*) as n_rows from webset_items group by 1""",
    "set_jaccard": f"""with t as (select id, parent_id, list_distinct({_TOK("lower(coalesce(text, ''))")}) as w from ruvector_docs)
        select c.id, round(case when len(c.w) = 0 or len(coalesce(p.w, [])) = 0 then 0 else len(list_intersect(c.w, p.w)) / len(list_distinct(list_concat(c.w, p.w))) end, 6) as jaccard from t c left join t p on p.id = c.parent_id where c.parent_id is not null""",
}
