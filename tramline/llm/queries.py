"""Registered queries of this package: each operator over its whole table, with its SQL twin where SQL can state it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate,
    divergence,
    hard_negatives,
    language,
    licenses,
    line_dedup,
    mixing,
    near_dup,
    packing,
    repetition,
    sharding,
    toxicity,
    trie_lm,
)
from .common import documents, held_out

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op1_suffix_repetition", rf"""
with recursive w as (select doc_id, text, {WORDS_SQL} as ws from documents),
t as (select doc_id, unnest(ws) as word, unnest(range(len(ws))) as i from w),
g as (select doc_id, i, list_aggregate(ws[i + 1:i + 5], 'string_agg', ' ') as k
      from (select doc_id, ws, unnest(range(len(ws) - 4)) as i from w where len(ws) >= 5)),
r as (select doc_id, i, dense_rank() over (order by doc_id, k) as key, 5 as n
      from g qualify count(*) over (partition by doc_id, k) > 1
      union all
      select doc_id, i, key, n from (
        select r.doc_id, r.i, dense_rank() over (order by r.key, t.word) as key, r.n + 1 as n,
               count(*) over (partition by r.key, t.word) as c
        from r join t on t.doc_id = r.doc_id and t.i = r.i + r.n) where c > 1),
m as (select doc_id, i, max(n) as n from r group by all),
five as (select doc_id, count(distinct j) as n_repeat_words from (select doc_id, unnest(range(i, i + 5)) as j from m) group by all),
ten as (select doc_id, max(n) as longest_repeat from m where n >= 10 group by all),
cov as (select doc_id, count(distinct j) as covered_words from (select doc_id, unnest(range(i, i + n)) as j from m where n >= 10) group by all),
lines as (select doc_id, count(*) - count(distinct line) as n_dup_lines
          from (select doc_id, unnest(string_split(text, chr(10))) as line from documents)
          where regexp_matches(line, '[^\x20\x09-\x0D]') group by all),
o as (select w.doc_id, cast(len(ws) as bigint) as n_words,
  cast(length(array_to_string(ws, '')) as bigint) as word_chars,
  cast(length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')) as bigint) as n_symbols,
  cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
  cast(coalesce(covered_words, 0) as bigint) as covered_words, cast(coalesce(longest_repeat, 0) as bigint) as longest_repeat
  from w left join five using (doc_id) left join ten using (doc_id) left join cov using (doc_id) left join lines using (doc_id))
select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and 100 * covered_words <= 15 * n_words and longest_repeat <= 100 as kept
from o""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words", "longest_repeat")


SHARDS = 40
# CRC-32 in SQL: the 256 steps of a byte, folded over the bytes of the text as hex digits
CRC_SQL = """
steps as (select list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k:
    case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n)) as t),
sums as (select doc_id, xor(list_reduce(list_transform(regexp_extract_all(hx, '..'), lambda x:
    cast('0x' || x as bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) as text_crc32
    from (select doc_id, text, hex(coalesce(text, '')) as hx from documents), steps)"""


@query("op5_interleaved_shards", f"""
with {CRC_SQL},
d as (select doc_id, coalesce(source, '') as source, source is null as no_source, coalesce(text, '') as text,
       md5('shards:' || coalesce(cast(doc_id as varchar), '')) as digest from documents),
r as (select *, (2 * row_number() over (partition by source, no_source order by digest, text) - 1)
       / (2 * count(*) over (partition by source, no_source)) as fraction from d),
p as (select *, row_number() over (order by fraction, case when no_source then 'n' else 'v' end || source, digest, text) - 1 as spot,
       count(*) over () as total from r),
s as (select *, spot * {SHARDS} // total as shard from p)
select doc_id, cast(strlen(text) + 16 as bigint) as size, text_crc32, 'rows' as law, cast(shard as int) as shard,
  cast(spot - (shard * total + {SHARDS - 1}) // {SHARDS} as bigint) as slot, cast(null as int) as grown_shard from s join sums using (doc_id)""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow = documents(spark, sf_dir).select(
        "doc_id", "source", (F.octet_length(F.coalesce(F.col("text"), F.lit("")).cast("binary")) + 16).cast("long").alias("size"),
        sharding.text_checksum().alias("text_crc32"))
    placed = sharding.interleaved_shards(narrow, SHARDS, checksum=F.col("text_crc32"))
    return placed.select("row.doc_id", "row.size", "row.text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@query("op6_line_dedup", rf"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
       unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos from documents),
k as (select doc_id, pos, line, {LOWER_SQL.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} as key from l),
c as (select key from k where length(key) >= 1 group by key having count(distinct doc_id) >= 10),
m as (select k.*, c.key is not null as gone from k left join c using (key))
select doc_id, count(*) as n_lines, cast(count(*) filter (gone) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256 from m group by doc_id""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, min_docs=10, min_chars=1))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


DOMAINS = ("web", "code", "books", "news")
WEIGHTS = {"domain": {"web": 3, "code": 2, "books": 2, "news": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}}


def domain_of():
    """The domain of a source: by its checksum, as ``documents`` names none."""
    return F.element_at(F.array(*[F.lit(x) for x in DOMAINS]), (F.crc32(F.col("source").cast("binary")) % 4 + 1).cast("int"))


def _fill_sql(name: str, below: str, path: str, level: str, parents: str) -> str:
    """CTEs that share the budgets of ``parents`` among the next level's children."""
    keys = f"{path}{', ' if path else ''}{level}"
    over = f"partition by {path}" if path else ""
    join = f"join {parents} p using ({path})" if path else f"cross join {parents} p"
    turn = f"({over} order by cap / w, {level} rows between unbounded preceding and 1 preceding)"
    return f"""
{name}_n as (select {keys}, any_value(p.budget) as budget, sum(cap) as cap, max(w_{level}) as w from {below} {join} group by {keys}),
{name}_l as (select *, (budget - coalesce(sum(cap) over {turn}, 0)) / (sum(w) over ({over}) - coalesce(sum(w) over {turn}, 0)) as lv from {name}_n),
{name}_m as (select *, max(lv) filter (cap / w > lv) over ({over}) as mark from {name}_l),
{name} as (select {keys}, cast(case when cap / w <= lv then cap else least(cap, floor(w * mark)) end as bigint) as budget from {name}_m)"""


MIX_SQL = rf"""
with steps as (select list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k:
    case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n)) as t),
src as (select source, list_extract(['web', 'code', 'books', 'news'], 1 + xor(list_reduce(list_transform(range(strlen(source)), lambda i:
    cast('0x' || hex(source)[2 * i + 1:2 * i + 2] as bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 4) as dom
    from (select distinct source from documents where source is not null), steps),
d as (select doc_id, lang, d.source, coalesce('v' || dom, 'n') as domain, coalesce('v' || lang, 'n') as lg, coalesce('v' || d.source, 'n') as so,
    cast(len({WORDS_SQL}) as bigint) as n_tokens from documents d left join src using (source)),
leaf as (select domain, lg, so, sum(n_tokens) as tokens, 2 * sum(n_tokens) as cap,
    case domain when 'vweb' then 3 when 'vcode' then 2 when 'vbooks' then 2 else 1 end as w_domain,
    case lg when 'ven' then 4 when 'vde' then 2 when 'vfr' then 2 when 'ves' then 2 else 1 end as w_lg, 1 as w_so from d group by all),
root as (select cast(floor(sum(tokens) * 5e-1) as bigint) as budget from leaf),
{_fill_sql("by_domain", "leaf", "", "domain", "root")},
{_fill_sql("by_lang", "leaf", "domain", "lg", "by_domain")},
{_fill_sql("by_source", "leaf", "domain, lg", "so", "by_lang")},
plan as (select domain, lg, so, budget, budget // tokens as whole, budget % tokens as rest from leaf join by_source using (domain, lg, so)
    where tokens > 0 and budget > 0),
u as (select * from d join plan using (domain, lg, so)),
part as (select *, sum(n_tokens) over (partition by domain, lg, so order by md5('mix:' || cast(cast(whole as int) as varchar) || ':' || coalesce(cast(doc_id as varchar), '')), n_tokens
    rows unbounded preceding) as upto from u where rest > 0)
select doc_id, lang, source, cast(unnest(range(cast(whole as bigint))) as int) as epoch, n_tokens, budget as leaf_budget from u
union all select doc_id, lang, source, cast(whole as int), n_tokens, budget from part where upto <= rest"""


@query("op7_source_mix", MIX_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "lang", "source", "text")
    picked = mixing.mix_sources(docs, domain_of(), WEIGHTS, share=0.5, max_epochs=2)
    return picked.select(F.col("row.doc_id").alias("doc_id"), F.col("row.lang").alias("lang"), F.col("row.source").alias("source"),
                         "epoch", "n_tokens", F.col("budget").alias("leaf_budget"))


@query("op8_hyperminhash", rf"""
with recursive w as (select doc_id, regexp_extract_all({LOWER_SQL.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, case when len(ws) < 4 then array_to_string(ws, ' ') else array_to_string(ws[i + 1:i + 4], ' ') end as g
      from (select doc_id, ws, unnest(range(greatest(1, len(ws) - 3))) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by all),
p as (select x.doc_id as a, y.doc_id as b, count(*) as both_n from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by all),
e as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * both_n >= 80 * (na.n + nb.n - both_n)),
c(doc_id, root) as (select a, a from e union select e.b, c.root from c join e on e.a = c.doc_id),
m as (select doc_id, min(root) as root from c group by all)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, coalesce(m.root, d.doc_id) as component_id,
  coalesce(m.root, d.doc_id) = d.doc_id as kept
from documents d left join n using (doc_id) left join m using (doc_id)""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicate_components(documents(spark, sf_dir), size=4, percent=80)


@query("op2_ppm_language")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    named = language.identify(docs, language.fit(docs, modulus=4))
    return named.select("row.doc_id", held_out("row.doc_id", 4).alias("held_out"), "lang_pred", "score", "bits_per_byte")


@query("op4_cgk_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), similarity_pct=80)


@query("op10_toxicity_chain")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@query("op9_elias_fano_lm")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_lm.trie_scores(documents(spark, sf_dir), modulus=7)


@query("op3_license_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


@query("op11_source_divergence", rf"""
with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all({LOWER_SQL.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ws, row_number() over () as doc from documents),
t as (select lang, source, doc, unnest(ws) as term from d),
k as (select lang, term, count(*) as lang_n from t group by all having count(distinct doc) >= 10),
v as (select lang, count(*) as v, sum(lang_n) as lang_total from k group by lang),
g as (select distinct lang, source from d),
c as (select g.lang, g.source, k.term, coalesce(n, 0) as n, lang_n from g join k using (lang)
      left join (select lang, source, term, count(*) as n from t group by all) using (lang, source, term)),
p as (select lang, source, term, n, 1 + (1000000000 * (n + 2)::hugeint) // (sum(n) over (partition by lang, source) + 2 * v)::hugeint as p,
      1 + (1000000000 * (lang_n + 2)::hugeint) // (lang_total + 2 * v)::hugeint as q from c join v using (lang)),
f as (select a.lang, a.source, b.source as item, cast(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as bigint) as value
      from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pair as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value
         from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source),
term as (select lang, source, 'term' as part, term as item, cast((p - q) * (p - q) // (p + q) as bigint) as value from p where n > 0 and p > q),
rows_ as (select * from pair union all select * from term)
select lang, source, part, item, value, cast(rank as int) as rank
from (select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank from rows_) where part = 'pair' or rank <= 10""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(documents(spark, sf_dir), min_docs=10, top_terms=10)


@query("op12_hard_negatives", """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
       list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
       where vec_id is not null and label is not null and embedding is not null
         and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
s as (select a.vec_id as anchor_id, b.vec_id as vec_id, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score
      from e a join e b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select * from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, p.vec_id as positive_id, cast(row_number() over w as int) as rank, n.vec_id as negative_id,
  p.score as positive_score, n.score as negative_score
from p join s n on n.anchor_id = p.anchor_id and not n.same and 80 * p.score <= 100 * n.score and n.score <= p.score
window w as (partition by p.anchor_id, p.vec_id order by n.score desc, n.vec_id)
qualify row_number() over w <= 5""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(hard_negatives.usable_rows(vectors, label=label), F.col("vec_id") % 100 == 0)


@query("op13_best_fit_packing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    packed = packing.pack_documents(documents(spark, sf_dir), path("byte_bpe_50k.json"), length=1024, end_id=2)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
