"""Registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fingerloom.llm import bpe, fmindex, languages, lattice, lines, negatives, rules, simhash, suffixes, toxicity, tries, urls
from fingerloom.llm import pages as html
from fingerloom.llm.common import crc_split

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLE[name] = sql
        return function
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Host and path rules of the contract, as text.
HOST_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Whole tokens that mark adult, gambling, advert and tracking addresses.
BLOCKED_TOKENS = ("porn", "xxx", "sex", "casino", "betting", "adserver", "doubleclick", "warez", "torrent", "phishing", "malware", "spam")
RULES = [*[urls.host_rule(*r) for r in HOST_RULES], *[urls.word_rule(w) for w in BLOCKED_TOKENS]]

_URL_SQL = f"""
with parts as (
  select page_id, case when url like '%://%' then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), split as (
  select page_id, regexp_extract(rest, '^[^/?#]*') as raw_host, rest from parts
), addresses as (
  select page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') as path from split
), rules(h, p, v) as (values {", ".join(str(r) for r in HOST_RULES)}),
best as (
  select page_id, arg_max(h || p, length(h || p)) as rule, arg_max(v, length(h || p)) as v
  from addresses join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id
)
select a.page_id, host, path, rule,
       coalesce(v, case when regexp_matches(host || path, '(^|[^A-Za-z0-9])({"|".join(BLOCKED_TOKENS)})([^A-Za-z0-9]|$)') then 'block' else 'allow' end) as verdict
from addresses a left join best b on a.page_id = b.page_id"""


@query("op1_url_filters", _URL_SQL)
def op1(spark, sf_dir):
    return urls.filter_urls(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op5_simhash_near_dedup")
def op5(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("row.doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_CONTAMINATION_SQL = f"""
with docs as (
  select doc_id, {_WORDS} as w from documents
), windows as (
  select distinct item_id, size, array_to_string(list_slice(w, i, i + size - 1), ' ') as phrase
  from (select item_id, w, least(13, len(w)) as size, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from (select item_id, {_WORDS} as w from benchmark) where len(w) > 0)
), places as (
  select doc_id, w, size, unnest(range(1, greatest(len(w) - size + 2, 1))) as i from docs, (select distinct size from windows)
), found as (
  select doc_id, i, p.size, item_id from (select doc_id, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') as phrase from places) p join windows using (phrase)
), hits as (
  select doc_id, count(distinct word) as n_hit from (select doc_id, unnest(range(i, i + size)) as word from found) group by doc_id
), items as (
  select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from found group by doc_id
)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from docs d left join hits using (doc_id) left join items using (doc_id)"""


@query("op10_benchmark_decontamination", _CONTAMINATION_SQL)
def op10(spark, sf_dir):
    found = fmindex.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), fmindex.contaminated().alias("contaminated"))


@query("op7_suffix_array_dedup")
def op7(spark, sf_dir):
    found = suffixes.without_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"])
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["end"] - s["start"])
    return found.select("row.doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


def byte_bpe() -> tuple[str, str]:
    """Vocabulary file and pattern of the contract; the file is read where it is installed."""
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@query("op6_byte_level_bpe")
def op6(spark, sf_dir):
    found = bpe.encode_and_check(table(spark, sf_dir, "documents"), *byte_bpe(), keep=["doc_id"])
    return found.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op4_lm_scoring")
def op4(spark, sf_dir):
    found = lattice.score(table(spark, sf_dir, "documents"), crc_split(F.col("doc_id"), 7) == 2, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
    return found.select("row.doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op3_quality_rules")
def op3(spark, sf_dir):
    found = rules.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return found.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op2_language_id")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = crc_split(F.col("doc_id"), 5) == 0
    found = languages.predict(docs, docs.where(~held_out), keep=["doc_id"])
    return found.select("row.doc_id", (crc_split(F.col("row.doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


@query("op8_toxicity")
def op8(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(toxicity.sample(docs, labels.where(crc_split(F.col("doc_id"), 3) != 1)))
    return toxicity.score(docs, model, keep=["doc_id"]).select(
        "row.doc_id", (crc_split(F.col("row.doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query("op9_html_extraction")
def op9(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    model = html.fit(html.training_pages(pages))
    return html.extract(pages, model, keep=["page_id", "url"]).select("row.page_id", "row.url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


_LINES_SQL = r"""
with split as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents
), keyed as (
  select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from split
), firsts as (
  select k, min(doc_id) as first_id from keyed where length(k) >= 10 group by k having count(distinct doc_id) > 1
), judged as (
  select keyed.*, first_id is not null and first_id <> doc_id as gone from keyed left join firsts using (k)
)
select doc_id, count(*) as n_lines, cast(count(*) filter (gone) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from judged group by doc_id"""


@query("op11_line_dedup", _LINES_SQL)
def op11(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = lines.apply_bitmaps(docs, lines.keep_bitmaps(docs), keep=["doc_id"])
    return found.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, items) of every conversation c behind the first turns of conversation c - c % 5, as the contract of op12 has it."""
    own = tries.sequences(conversations)
    heads = own.select(F.col("conv_id").alias("base"), F.slice("items", 1, 8).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    joined = own.withColumn("h", h).join(heads, F.col("conv_id") - F.col("conv_id") % 5 == F.col("base"), "left")
    first = F.slice(F.coalesce("head", F.array().cast(tries.ITEMS)), F.lit(1), F.col("h"))
    rest = F.slice("items", F.col("h") + 1, F.greatest(F.size("items") - F.col("h"), F.lit(0)))
    return joined.select("conv_id", F.concat(first, rest).alias("items"))


_TRIE_SQL = """
with given as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as pos
  from conversations where conv_id is not null
), sizes as (
  select conv_id, count(*) as n,
    xor(4294967295::ubigint, list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::ubigint)),
      lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)::ubigint[]), lambda b, i: xor(b >> 1, case when b % 2 = 1 then 3988292384::ubigint else 0::ubigint end)))) % 9 as h
  from given group by conv_id
), rebuilt as (
  select s.conv_id, g.pos, g.role, g.text from sizes s join given g on g.conv_id = s.conv_id - s.conv_id % 5 and g.pos < s.h
  union all
  select s.conv_id, least(s.h, coalesce(b.n, 0)) + g.pos - s.h, g.role, g.text
  from sizes s left join sizes b on b.conv_id = s.conv_id - s.conv_id % 5 join given g on g.conv_id = s.conv_id and g.pos >= s.h
), prefixes as (
  select conv_id, cast(pos + 1 as bigint) as depth, strlen(text) as bytes, md5(string_agg(md5(strlen(role) || ':' || role || text), '') over (partition by conv_id order by pos)) as k from rebuilt
  union all select conv_id, 0, 0, '' from sizes
), members as (
  select *, lag(k) over (partition by conv_id order by depth) as above, depth = max(depth) over (partition by conv_id) as ends from prefixes
), nodes as (
  select k, any_value(depth) as depth, any_value(above) as above, any_value(bytes) as bytes, min(conv_id) as conv_id, count(*) as n_convs,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) as ends_sha256
  from members group by k
), children as (
  select above as k, count(*) as n_children from nodes where above is not null group by above
), sums as (
  select m.k, count(*) filter (c.k is null) as n_leaves, cast(sum((n.n_convs - 1) * n.bytes) as bigint) as saved_tokens
  from nodes n join members m on m.conv_id = n.conv_id and m.depth <= n.depth left join children c on c.k = n.k group by m.k
)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(c.n_children, 0) as n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
from nodes n join sums s on s.k = n.k left join children c on c.k = n.k left join nodes p on p.k = n.above"""


@query("op12_conversation_prefix_trie", _TRIE_SQL)
def op12(spark, sf_dir):
    return tries.prefix_trie(rebuilt(table(spark, sf_dir, "conversations"))).drop("node")


_NEGATIVES_SQL = """
with rows as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), pairs as (
  select a.vec_id as anchor_id, a.label = b.label as same, b.vec_id as id, cast(list_dot_product(a.v, b.v) as bigint) as score
  from rows a join rows b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id
), positives as (
  select * from pairs where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
)
select p.anchor_id, p.id as positive_id, cast(row_number() over (partition by p.anchor_id, p.id order by n.score desc, n.id) as int) as rank,
       n.id as negative_id, p.score as positive_score, n.score as negative_score
from positives p join pairs n on n.anchor_id = p.anchor_id and not n.same and 50 * p.score <= 100 * n.score and 100 * n.score <= 95 * p.score
qualify rank <= 3"""


@query("op13_hard_negatives", _NEGATIVES_SQL)
def op13(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), x.cast("double")).otherwise(F.floor(256 * x.cast("double")).cast("double")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), whole.alias("embedding"))
    return negatives.mine(rows, F.col("id") % 50 == 0)
