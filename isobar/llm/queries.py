"""The queries of this package over the tables, with production parameters, and their oracles in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.llm import language, perplexity, quality
from isobar.llm.bpe import bpe_roundtrip
from isobar.llm.decontaminate import contamination
from isobar.llm.jaccard import jaccard_groups
from isobar.llm.lines import drop_boilerplate
from isobar.llm.shared import shared_dir
from isobar.llm.substrings import remove_repeats
from isobar.llm.tokenfile import read_token_file, write_token_file
from isobar.llm.urls import judge_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP1_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w from benchmark where item_id is not null),
bw as (select distinct item, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as gram
       from (select item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as gram
       from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
m as (select doc_id, dw.n, i, item from dw join bw on dw.n = bw.n and dw.gram = bw.gram),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from m) group by doc_id),
its as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from m group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join its using (doc_id)
"""


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


#: The rules of the URL filter query.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

OP6_SQL = r"""
with r(rh, rp, v) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u as (select page_id, case when strpos(coalesce(url, ''), '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
s as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path from u),
k as (select distinct host, path from s),
best as (select host, path, arg_max(rh || rp, length(rh || rp)) as rule, arg_max(v, length(rh || rp)) as v
         from k join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by host, path)
select page_id, s.host, s.path, rule, coalesce(v, 'allow') as verdict from s left join best on s.host = best.host and s.path = best.path
"""


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents")).select("doc_id", "class_id", F.hex("set_key").alias("set_key"), "n_shingles", "n_links")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    fold = lambda c: F.coalesce(F.crc32(c.cast("string")), F.lit(0)) % 3
    model = quality.fit(documents, table(spark, sf_dir, "labels"), fold(F.col("doc_id")) != 1)
    scored = quality.score_quality(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.judge_quality(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % 5
    model = language.fit(documents, fold != 0)
    predicted = language.predict_language(documents, model)
    return predicted.select("doc_id", (fold == 0).alias("held_out"), "lang_pred", "score")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "source", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


OP4_SQL = r"""
with d as (select doc_id, source, text, string_split(text, chr(10)) as lines from documents),
n as (select source, count(*) as total from d group by source),
l as (select source, line, count(*) as c from (select source, unnest(list_distinct([trim(x, ' ') for x in lines if trim(x, ' ') <> ''])) as line from d) group by all),
bad as (select source, list(line) as bad from l join n using (source) where c >= 2 and c > total * 0.08 group by source),
k as (select d.*, case when bad is null then lines else [x for x in lines if trim(x, ' ') = '' or not list_contains(bad, trim(x, ' '))] end as kept from d left join bad using (source))
select doc_id, source, cast(len([x for x in lines if trim(x, ' ') <> '']) as bigint) as n_lines, cast(len(lines) - len(kept) as bigint) as n_dropped,
       sha256(case when len(kept) = len(lines) then text else coalesce(array_to_string(kept, chr(10)), '') end) as text_sha256 from k
"""


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_units", "n_removed", F.transform("spans", lambda x: F.concat_ws("-", x["start"], x["end"])).alias("spans"), "text").withColumn("spans", F.array_join("spans", ","))


OP7_SQL = r"""
with t as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[\x09-\x0D ]*(?:[UNSPACED]|[^\x09-\x0D UNSPACED]+)') as pieces from documents),
p as (select doc_id, unnest(range(len(pieces))) as i, unnest(pieces) as piece from t),
w as (select doc_id, i, regexp_replace(piece, '^[\x09-\x0D ]*', '') as word, strpos(regexp_extract(piece, '^[\x09-\x0D ]*'), chr(10)) > 0 as fresh,
             sum(length(piece)) over (partition by doc_id order by i) as stop from p),
x as (select doc_id, i, stop, stop - length(word) as start, fresh, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as word from w),
c as (select *, list_sum([unicode(z) for z in string_split(word, '')]) % 8 = 0 or regexp_matches(word, '[.!?\x{3002}\x{FF01}\x{FF1F}]$') as cut from x),
s as (select *, sum(cast(fresh or coalesce(before, true) as int)) over (partition by doc_id order by i) as seg from (select *, lag(cut) over (partition by doc_id order by i) as before from c)),
k as (select *, (row_number() over (partition by doc_id, seg order by i) - 1) // 12 as nth from s),
u as (select doc_id, seg, nth, min(start) as start, max(stop) as stop, count(*) as words, string_agg(word, ' ' order by i) as norm from k group by all),
r as (select *, row_number() over (partition by doc_id order by seg, nth) as unit, row_number() over (partition by norm order by doc_id, seg, nth) > 1 as again from u),
g as (select *, unit - row_number() over (partition by doc_id, again order by unit) as island from r),
z as (select *, again and sum(words) over (partition by doc_id, again, island) >= 25 as gone from g),
spans as (select doc_id, cast(min(start) as bigint) as start, cast(max(stop) as bigint) as stop, count(*) as n from z where gone group by doc_id, island),
left_ as (select *, coalesce(lag(stop) over (partition by doc_id order by start), 0) as since from spans),
cutout as (select doc_id, cast(sum(n) as bigint) as n_removed, string_agg(start || '-' || stop, ',' order by start) as spans, max(stop) as tail,
                  string_agg(substr(text, since + 1, start - since), '' order by start) as head from left_ join t using (doc_id) group by doc_id),
n as (select doc_id, count(*) as n_units from u group by doc_id)
select t.doc_id, coalesce(n_units, 0) as n_units, coalesce(n_removed, 0) as n_removed, coalesce(spans, '') as spans,
       case when d.text is null then null when cutout.doc_id is null then t.text else head || substr(t.text, tail + 1) end as text
from t join documents d using (doc_id) left join n using (doc_id) left join cutout using (doc_id)
""".replace("UNSPACED", r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{2E80}-\x{2FFF}\x{3004}-\x{FEFF}\x{FF10}-\x{10FFFF}")


def op5_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_token_file(table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=1)
    return read_token_file(spark, path, ids=False)


def op10_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_roundtrip(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_line_dedup": op4_line_dedup,
    "op5_token_file": op5_token_file,
    "op6_url_filter": op6_url_filter,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_language_id": op9_language_id,
    "op10_bpe_roundtrip": op10_bpe_roundtrip,
}

ORACLES: dict[str, str] = {
    "op1_decontamination": OP1_SQL,
    "op4_line_dedup": OP4_SQL,
    "op6_url_filter": OP6_SQL,
    "op7_substring_dedup": OP7_SQL,
}
