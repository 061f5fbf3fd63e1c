"""One query per operator, over its whole table with production parameters, and its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.llm import common as C
from mergeloom.llm import decontaminate, exact, jaccard, mixing, quality, substring, suffix, tokenids, toxicity, warc

#: The words of ``text`` in SQL.
WORDS = r"regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+')"


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_classes(C.table(spark, sf_dir, "documents"))


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_scores(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))


def op3_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the budget of its SQL; by default, as in the pipeline, mix leaves no document out
    return mixing.mix(C.table(spark, sf_dir, "documents"), budget=mixing.LEAST).select("doc_id", "source", "text", "n_tokens", F.round("position", 9).alias("position"))


def op4_warc_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = warc.reassemble(warc.page_records(C.table(spark, sf_dir, "pages")))
    page = F.regexp_extract("record_id", "^<urn:page:(-?[0-9]+):", 1).cast("long")
    return done.select(page.alias("page_id"), "url", F.col("body").alias("html"), "status")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.suffix_repeats(C.table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(C.table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(C.table(spark, sf_dir, "documents"))


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenids.encode(C.table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_copies(C.table(spark, sf_dir, "documents"))


def _repeats(elsewhere: str) -> str:
    return f"""
with w as (select doc_id, {WORDS} w from documents where doc_id is not null),
s as (select doc_id, unnest(range(len(w) - 49)) i, w from w where len(w) >= 50),
h as (select doc_id, i, array_to_string(w[i + 1 : i + 50], ' ') h from s),
r as (select doc_id, i, row_number() over (partition by h order by doc_id, i) = 1 f
      from h qualify {elsewhere}),
g as (select *, i - row_number() over (partition by doc_id, f order by i) k from r)
select doc_id, min(i)::int start_word, (count(*) + 49)::int n_words, f is_first from g group by doc_id, f, k"""


QUERIES = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_toxicity": op2_toxicity,
    "op3_mixing_sources": op3_mixing_sources,
    "op4_warc_reassembly": op4_warc_reassembly,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_token_ids": op8_token_ids,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
}

ORACLE = {
    "op1_benchmark_decontamination": f"""
with i as (select {WORDS} w from benchmark),
k as (select w, greatest(6, least(12, ceil(0.6 * len(w) - 1e-9)))::int k from i),
g as (select distinct k, array_to_string(w[j + 1 : j + k], ' ') g
      from (select w, k, unnest(range(len(w) - k + 1)) j from k where len(w) >= k)),
d as (select row_number() over () r, doc_id, text, {WORDS} w from documents),
x as (select r, j, k, array_to_string(w[j + 1 : j + k], ' ') g
      from (select r, w, k, unnest(range(len(w) - k + 1)) j from d, (select distinct k from g) where len(w) >= k)),
f as (select r, list(distinct p) p from (select r, unnest(range(j + 1, j + 1 + k)) p from x join g using (k, g)
      union all select r, unnest(range(1, len(w) + 1)) p from d where len(w) between 1 and 5 and w in (select w from i)) group by r),
m as (select d.*, p, regexp_split_to_array(text, '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+') s,
        regexp_extract_all(text, '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+') o from d left join f using (r))
select doc_id, case when p is null then text else array_to_string(list_transform(range(1, len(o) + 2), lambda q:
    (case when list_contains(p, q - 1) and list_contains(p, q) then '' else s[q] end) ||
    (case when q > len(o) or list_contains(p, q) then '' else o[q] end)), '') end as text,
  len(w)::int n_words, coalesce(len(p), 0)::int n_removed from m""".replace("\\\\", "\\"),
    "op9_exact_dedup": """
select distinct doc_id, k keep_id from (select doc_id, min(doc_id) over (partition by text) k
  from documents where text is not null and doc_id is not null) where doc_id <> k""",
    "op3_mixing_sources": r"""
with d as (select doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x09-\x0d ]+')), 0) n_tokens,
        md5(coalesce(doc_id::varchar, '') || ':0') o from documents),
c as (select *, coalesce(sum(n_tokens) over (partition by coalesce(source, '') order by o, doc_id, n_tokens
        rows between unbounded preceding and 1 preceding), 0) c from d),
s as (select coalesce(source, '') s, sum(n_tokens) supply from d group by 1),
w as (select s, supply, supply::double / greatest(sum(supply) over (), 1) a, 1.0::double / count(*) over () b from s),
m as (select *, (a + b) / 2 share, min(supply::double / ((a + b) / 2)) over () most from w),
p as (select c.*, a, b, share, c::double / greatest(most, 1) x from c join m on coalesce(source, '') = s)
select doc_id, source, text, n_tokens::bigint n_tokens,
  round(least(1, case when x <= 0 then 0 else 2 * x / (a + sqrt(greatest(0, a * a + 2 * (b - a) * x))) end), 9) as "position"
from p where x < share""",
    "op4_warc_reassembly": "select page_id, coalesce(url, '') url, coalesce(html, '') html, 'ok' status from pages where page_id is not null",
    "op5_suffix_array_dedup": _repeats("count(*) over (partition by h) > 1"),
    "op6_substring_dedup": _repeats("min(doc_id) over (partition by h) <> max(doc_id) over (partition by h)"),
    "op10_ngram_jaccard_join": f"""
with recursive w as (select doc_id, {WORDS} w from documents where doc_id is not null),
s as (select distinct doc_id, list_sort(list_distinct(case when len(w) < 3 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end)) g
      from w where len(w) > 0),
m as (select g, min(doc_id) rep, count(*) copies, len(g) n from s group by g),
e as (select rep, n, copies, unnest(g) q from m),
p as (select a.rep a, b.rep b, b.copies from e a join e b on a.q = b.q and a.rep <> b.rep group by a.rep, b.rep, a.n, b.n, b.copies
      having count(*) / (a.n + b.n - count(*)) >= 0.7),
k as (select a, sum(copies) n from p group by a),
c(rep, root) as (select rep, rep from m union select p.b, c.root from c join p on c.rep = p.a),
r as (select rep, min(root) root from c group by rep)
select doc_id, root class_id, (coalesce(k.n, 0) + copies - 1)::bigint n_links
from s join m using (g) join r using (rep) left join k on k.a = rep where coalesce(k.n, 0) + copies > 1""",
}
