"""The subpackage's queries over the given tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import coordinates, decontaminate, licenses, lines, packing, quality, repair, simhash, substrings, tokens, urls, warc, whitening
from .common import table

SEQUENCE, END_ID = 1024, 2


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.quality(docs, field, carry=["doc_id"]).select("doc_id", "quality.*")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokens.prefix_table(table(spark, sf_dir, "documents"), tokenizer())
    return tokens.within_budget(found, SEQUENCE)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), tokenizer(), SEQUENCE, END_ID), SEQUENCE)


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, bad): a page shows the document whose number ends its path; bad is that one's quality 0."""
    _, path = urls.host_and_path(F.col("url"))
    shown = pages.select("page_id", F.regexp_extract(path, r"/([0-9]{1,18})(?:\.html|/)?$", 1).alias("n")).where("n <> ''")
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.max(1 - F.col("quality")).alias("bad"))
    return shown.select("page_id", F.col("n").cast("bigint").alias("doc_id")).join(known, "doc_id").select("page_id", "bad")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.url_filter(pages, page_outcomes(pages, table(spark, sf_dir, "labels"))).drop("posterior", "bound")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write_archive(table(spark, sf_dir, "pages"), least=100)
    return warc.digest_table(warc.read_archive(spark, archive))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = lines.line_dedup(docs, min_docs=10, min_chars=1)
    return found.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.encode("lines.kept", "UTF-8"), 256).alias("kept_sha256"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.substring_dedup(table(spark, sf_dir, "documents"), length=50, with_kept=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = coordinates.near_copies(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_conversations(table(spark, sf_dir, "conversations"))


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op1: the base phrases."""
    return op1_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op2: the base rules, and that what fails them isn't kept."""
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return op2_quality_rules(spark, sf_dir).select(*base, (F.col("base_failed") & F.col("kept")).alias("failed_and_kept"))


def url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands behind op6's verdicts: each host's labelled pages, posterior share of bad ones and its lower bound."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    found = urls.url_filter(pages, page_outcomes(pages, table(spark, sf_dir, "labels")))
    return found.groupBy("host").agg(F.count("*").alias("pages"), F.round(F.max("posterior"), 6).alias("posterior"), F.round(F.max("bound"), 6).alias("bound"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_license_scan, op2_quality_rules, op3_token_counts, op4_simhash, op5_packing, op6_url_filter, op7_decontamination,
        op8_warc, op9_line_dedup, op10_substring_dedup, op11_minhash, op12_whitening, op13_conversation_repair, license_base, quality_base, url_reputation,
    )
    return {f.__name__: f for f in own}


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_FITS = " when ".join(
    f"(host = '{name}' or host like '%.{name}') and starts_with(path, '/{rest}') then struct_pack(rule := '{rule}', verdict := '{verdict}')"
    for verdict, rule in sorted(urls.RULES, key=lambda r: -len(r[1]))
    for name, _, rest in [rule.partition("/")]
)


def _level(name: str, rows: str, keys: str, up: str, join: str) -> str:
    """CTEs of one level of shrinkage: its groups with their parents' mean, its strength, its posteriors."""
    return f"""{name} as (select g.*, m from (select {keys}, sum(n) as n, sum(bad) as bad from {rows} group by all) g {join.format(up=up)}),
    k{name} as (select case when s is null or s <= noise then {urls.STRENGTH[1]} else greatest({urls.STRENGTH[0]}, least({urls.STRENGTH[1]}, (whole - s) / (s - noise))) end as k
        from (select sum(n * (bad / n - m) ^ 2) as s, sum(m * (1 - m)) as noise, sum(n * m * (1 - m)) as whole from {name} where n > 0)),
    p{name} as (select {keys}, n, k, (k * m + bad) / (k + n) as m from {name}, k{name})"""


_TWO = f"array_to_string(string_split(host, '.')[-2:], '.') in {urls.DOUBLE}"

_URLS = f"""with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
    p as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), {_AZ}) as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
    known as (select doc_id, max(1 - quality) as bad from labels where quality in (0, 1) group by 1),
    shown as (select page_id, try_cast(regexp_extract(path, '/([0-9]{{1,18}})(?:\\.html|/)?$', 1) as bigint) as doc_id from p),
    marks as (select page_id, max(bad) as bad from shown join known using (doc_id) group by 1),
    hosts as (select host, array_to_string(string_split(host, '.')[(case when {_TWO} then -2 else -1 end):], '.') as suffix,
        array_to_string(string_split(host, '.')[(case when {_TWO} then -3 else -2 end):], '.') as domain, count(bad) as n, coalesce(sum(bad), 0) as bad from p left join marks using (page_id) group by all),
    top as (select (sum(bad) + 1) / (sum(n) + 2) as m from hosts),
    {_level('a', 'hosts', 'suffix', 'top', ', {up}')},
    {_level('b', 'hosts', 'suffix, domain', 'pa', 'join (select suffix, m from {up}) using (suffix)')},
    {_level('c', 'hosts', 'suffix, domain, host', 'pb', 'join (select suffix, domain, m from {up}) using (suffix, domain)')},
    judged as (select page_id, host, path, m, m - 1.645 * sqrt(m * (1 - m) / (k + n + 1)) as low, case when {_FITS} end as best from p join pc using (host))"""

URLS_SQL = f"{_URLS} select page_id, host, path, best.rule as rule, coalesce(best.verdict, case when low > 0.2 then 'block' else 'allow' end) as verdict from judged"
REPUTATION_SQL = f"{_URLS} select host, count(*) as pages, round(max(m), 6) as posterior, round(max(low), 6) as bound from judged group by host"

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LICENSES_SQL = f"""with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_WORDS}') as w from documents),
    x as (select doc_id, unnest(w) as t, unnest(range(len(w))) as i from w),
    n as (select doc_id, i, [t, lead(t, 1) over o, lead(t, 2) over o, lead(t, 3) over o] as t from x window o as (partition by doc_id order by i)),
    h as (select doc_id, i, case {' '.join(f"when t[1:{len(p.split())}] = {p.split()} then '{x}'" for x, p in licenses.PHRASES.items())} end as label from n),
    f as (select doc_id, count(*) as n_base, min(i) as first_word, max(i) as last_word, string_agg(distinct label, ',' order by label) as base_labels from h where label is not null group by doc_id)
    select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels from w left join f using (doc_id)"""

_BLACK = r"[^\x20\x09-\x0D]"
QUALITY_SQL = f"""with w as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{_BLACK}+') as w from documents),
    x as (select doc_id, unnest(w) as t, unnest(range(len(w))) as i from w),
    g as (select doc_id, i, t || ' ' || lead(t, 1) over o || ' ' || lead(t, 2) over o || ' ' || lead(t, 3) over o || ' ' || lead(t, 4) over o as g from x window o as (partition by doc_id order by i)),
    twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from g where g is not null) where n > 1),
    again as (select doc_id, count(distinct j) as n from (select doc_id, unnest(range(i, i + 5)) as j from twice) group by doc_id),
    l as (select doc_id, count(*) - count(distinct line) as n from (select doc_id, unnest(string_split(text, chr(10))) as line from w) where regexp_matches(line, '{_BLACK}') group by doc_id),
    b as (select doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
        cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, coalesce(l.n, 0) as n_dup_lines, coalesce(again.n, 0) as n_repeat_words
        from w left join l using (doc_id) left join again using (doc_id))
    select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, false as failed_and_kept from b"""

WARC_SQL = """with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
    f as (select *, min(page_id) over (partition by payload_digest) as first from p)
    select page_id, payload_bytes, payload_digest, case when payload_bytes < 100 or page_id = first then 'response' else 'revisit' end as record_type,
    case when payload_bytes < 100 or page_id = first then null else first end as refers_to from f"""

LINES_SQL = f"""with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
    x as (select doc_id, unnest(l) as line, unnest(range(1, len(l) + 1)) as pos from d),
    k as (select *, translate(trim(line, {_BLANKS}), {_AZ}) as key from x),
    often as (select key from k where key <> '' group by key having count(distinct doc_id) >= 10),
    m as (select *, key in (select key from often) as gone from k)
    select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256 from m group by doc_id"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express; tests hold the others against plain versions."""
    return {
        "op6_url_filter": URLS_SQL, "op8_warc": WARC_SQL, "op9_line_dedup": LINES_SQL, "license_base": LICENSES_SQL, "quality_base": QUALITY_SQL,
        "url_reputation": REPUTATION_SQL,
    }
