"""Registered queries for the tokenizer's own operators, each over whole tables, and their DuckDB SQL."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.functions import alphabets as A
from mergeloom.functions import patterns as P
from mergeloom.functions import sql as sqlfuncs
from mergeloom.operators import inventory as I
from mergeloom.operators.encoder import BpeEncoder
from mergeloom.operators.pretokenizer import PreTokenizer
from mergeloom.operators.trainer import BpeTrainer
from mergeloom.plans import distributed
from mergeloom.plans import model as M
from mergeloom.sources import segments, sinks, texts
from mergeloom.streaming import counts as streams

SPECIALS = ["The ", "And ", " | "]
STEPS, MANY_STEPS, CUTOFF, TOP, MIN_FREQ, SCALED = 12, 32, 20_000, 50, 16, 1_000_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PreTokenizer().words(_docs(spark, sf_dir))


def _shared(spark: SparkSession) -> str:
    """The folder that all machines share; a temporary one only where there is one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not (spark.sparkContext.master + "[").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="mergeloom-")


# --- SQL parts: RE2 has no look-ahead, so the last white space before other text is marked first

_W = r"\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_L = r"A-Za-z\x{C0}-\x{24F}"


def _pieces(text: str) -> str:
    marked = rf"regexp_replace({text}, '([{_W}]+)([{_W}][^{_W}])', '\1' || chr(57344) || '\2', 'g')"
    return rf"regexp_extract_all({marked}, '''(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_W}\p{{L}}\p{{N}}\x{{E000}}]+|[{_W}]+')"


_SPECIAL = r"The |And | \| "
_WORDS = f"words as (select w as word, count(*) as freq from (select unnest({_pieces('text')}) as w from documents) group by 1)"
_CHUNKED = f"select unnest(list_transform(string_split_regex(text, '{_SPECIAL}'), lambda c: {_pieces('c')})) as ps from documents"
_LETTER_PAIRS = f"""pairs as (select pair, count(*) as freq from (select substr(run, i, 2) as pair
  from (select run, unnest(range(1, len(run))) as i from (select unnest(regexp_extract_all(text, '[{_L}]{{2,}}')) as run from documents)))
  group by 1)"""


#: Words of the documents, and those of the benchmark that are to be encoded too, which count nothing.
_WORDS_TOO = f"words as (select w as word, sum(n)::bigint as freq from (select unnest({_pieces('text')}) as w, n from (select text, 1 as n from documents union all select text, 0 from benchmark)) group by 1)"


def _training(steps: int, least: int = 1, words: str = _WORDS) -> str:
    """Recursive training over all words: t(step, word, s, freq, l, r, mf)."""
    return f"""{words},
t(step, word, s, freq, l, r, mf) as (
  select 0, word, array_to_string(list_transform(regexp_extract_all(hex(encode(word)), '..'),
      lambda x: '<' || lpad(cast(('0x' || x)::int as varchar), 5, '0') || '>'), ''),
    freq, cast(null as varchar), cast(null as varchar), cast(null as bigint)
  from words
  union all (
    with p as (select unnest(list_zip(x[1:len(x)-1], x[2:])) z, freq
               from (select regexp_extract_all(s, '<[0-9]+>') x, freq from t where t.step < {steps}) where len(x) > 1),
    best as (select * from (select z[1] l, z[2] r, sum(freq)::bigint f from p group by all order by f desc, l, r limit 1) where f >= {least})
    select step + 1, word, replace(s, best.l || best.r, '<' || lpad(cast(256 + step as varchar), 5, '0') || '>'), freq, best.l, best.r, best.f
    from t, best where step < {steps}))"""


_MERGES = "select distinct step - 1 as rank, l[2:6]::int as left_id, r[2:6]::int as right_id, (255 + step)::int as target_id, mf as freq from t where step > 0"
_IDS = f"ids as (select word, list_transform(regexp_extract_all(s, '[0-9]+'), lambda x: x::int) as ids from t where step = {STEPS})"


#: The tokens of the model by id, in hexadecimal.
_TOKENS = f"""m as materialized (select distinct step, l[2:6]::int as l, r[2:6]::int as r from t where step > 0),
v(n, tokens) as (select 0, list_transform(range(256), lambda i: right('0' || to_hex(i), 2))
  union all select n + 1, list_append(tokens, tokens[l + 1] || tokens[r + 1]) from v join m on m.step = n + 1),
tokens as (select i::int as id, lower(tokens[i + 1]) as token from (select tokens, unnest(range(len(tokens))) as i from v where n = {STEPS}))"""


# --- counting


@query(f"with {_WORDS} select word, freq from words")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir)


@query(f"select lang, w as word, count(*) as freq from (select lang, unnest({_pieces('text')}) as w from documents) group by all")
def word_count_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("lang", F.explode(P.words(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("freq"))


@query(f"select conv_id, turn, pos - 1 as pos, ps[pos] as piece from (select conv_id, turn, ps, unnest(range(1, len(ps) + 1)) as pos from (select conv_id, turn, {_pieces('text')} as ps from conversations))")
def pieces_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PreTokenizer().pieces(_docs(spark, sf_dir, "conversations")).select("conv_id", "turn", "pos", "piece")


@query(f"""with c as (select doc_id, string_split_regex(text, '{_SPECIAL}') as cs, regexp_extract_all(text, '{_SPECIAL}') as ss from documents),
e as (select doc_id, k, cs[k] as c, ss[k] as s from (select *, unnest(range(1, len(cs) + 1)) as k from c)),
p as (select doc_id, k, 0 as after, j, ps[j] as piece, false as is_special from (select doc_id, k, ps, unnest(range(1, len(ps) + 1)) as j from (select doc_id, k, {_pieces('c')} as ps from e))
  union all select doc_id, k, 1, 0, s, true from e where s is not null)
select doc_id, row_number() over (partition by doc_id order by k, after, j) - 1 as pos, piece, is_special from p""")  # fmt: skip
def special_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PreTokenizer(SPECIALS).pieces(_docs(spark, sf_dir)).select("doc_id", "pos", "piece", "is_special")


@query(f"select word, count(*) as freq from (select unnest(ps) as word from ({_CHUNKED})) group by 1")
def special_excluded_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PreTokenizer(SPECIALS).words(_docs(spark, sf_dir))


@query(f"select word, count(*) as freq from (select unnest(regexp_extract_all(html, '[^{_W}]+')) as word from pages) group by 1")
def custom_pattern_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PreTokenizer(pat_str=r"\S+").words(_docs(spark, sf_dir, "pages"), "html")


@query(f"""with {_WORDS} select count(*) as unique_words, sum(freq)::bigint as occurrences, count(*) filter (freq = 1) as singletons,
count(*)::double / sum(freq)::double as unique_ratio, min(len(word))::int as min_length, quantile_cont(len(word), 0.5) as median_length,
quantile_cont(len(word), 0.9) as p90_length, max(len(word))::int as max_length from words""")
def inventory_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.summary(_words(spark, sf_dir))


@query(f"select word, count(*) as freq from (select unnest({_pieces('text')}) as word from (select text from documents union all select text from conversations)) group by 1")
def inventory_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.merged(_words(spark, sf_dir), PreTokenizer().words(_docs(spark, sf_dir, "conversations")))


@query(f"with {_WORDS} select word, freq from words order by freq desc, word desc limit 100")
def inventory_sorted_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.sorted_words(_words(spark, sf_dir)).limit(100)


@query(f"with {_WORDS} select word, freq from words where word not in ('The', ' the', '.')")
def inventory_minus_special(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.without(_words(spark, sf_dir), ["The", " the", "."])


@query(f"""with {_WORDS}, n as (select sum(freq)::hugeint as total from words),
p as (select word, (freq::hugeint * {SCALED}) // total as base, (freq::hugeint * {SCALED}) % total as rest from words, n),
r as (select *, row_number() over (order by rest desc, word) as k, {SCALED} - sum(base) over () as missing from p)
select word, (base + (k <= missing)::int)::bigint as freq from r where base + (k <= missing)::int > 0""")
def inventory_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.scaled(_words(spark, sf_dir), SCALED)


# --- bigrams


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PreTokenizer(script=P.LETTERS).bigram_counts(_docs(spark, sf_dir))


@query(f'with {_LETTER_PAIRS} select pair[1] as "left", pair[2] as "right", freq from pairs')
def bigram_count_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _letters(spark, sf_dir)


@query(f'with {_LETTER_PAIRS} select pair[1] as "left", pair[2] as "right", freq from pairs where freq >= {MIN_FREQ} qualify rank() over (order by freq desc) <= {TOP}')
def bigram_topk_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.top_bigrams(_letters(spark, sf_dir), TOP, MIN_FREQ)


_KEPT = f"kept as (select pair, freq from pairs where freq >= {MIN_FREQ} qualify rank() over (order by freq desc) <= {TOP})"


@query(f"""with {_LETTER_PAIRS}, {_KEPT} select (select count(*) from kept) as selected, (select min(freq) from kept) as cutoff_freq,
(select max(freq) from pairs where pair not in (select pair from kept)) as max_excluded_freq""")
def bigram_selection_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = I.select_bigrams(_letters(spark, sf_dir), TOP, MIN_FREQ)
    return spark.createDataFrame([(len(s.bigrams), s.cutoff_freq, s.max_excluded_freq)], "selected long, cutoff_freq long, max_excluded_freq long")


def _segmented(mixed: str) -> str:
    return f"""with {_WORDS}, {_LETTER_PAIRS}, {_KEPT},
c as (select word, freq, k, substr(word, k, 1) as ch, substr(word, k - 1, 2) as pair from (select word, freq, unnest(range(1, len(word) + 1)) as k from words)),
f as (select word, freq, k, ch, k > 1 and ((regexp_matches(pair, '^[{_L}]{{2}}$') and pair not in (select pair from kept)) or {mixed}) as cut from c),
g as (select word, freq, k, ch, sum(cut::int) over (partition by word order by k) as n from f),
s as (select word, freq, n, string_agg(ch, '' order by k) as part from g group by all)
select part as word, sum(freq)::bigint as freq from s group by 1"""


def _segment(spark: SparkSession, sf_dir: str, mixed: str) -> DataFrame:
    kept = I.select_bigrams(_letters(spark, sf_dir), TOP, MIN_FREQ).bigrams
    return PreTokenizer(unicode_bigrams=kept, unicode_bigram_mixed_boundary=mixed, script=P.LETTERS).words(_docs(spark, sf_dir))


@query(_segmented("false"))
def bigram_segment_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segment(spark, sf_dir, "keep")


@query(_segmented(f"regexp_matches(pair[1], '[{_L}]') <> regexp_matches(pair[2], '[{_L}]')"))
def bigram_segment_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segment(spark, sf_dir, "split")


@query(f"with recursive {_LETTER_PAIRS}, {_KEPT}, {_training(STEPS)} select (select max(freq) from pairs where pair not in (select pair from kept)) < min(mf) as unchanged from t where step = {STEPS}")
def frequency_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    selection = I.select_bigrams(_letters(spark, sf_dir), TOP, MIN_FREQ)
    return spark.createDataFrame([(I.frequency_guard(selection, _trained(spark, sf_dir).last_merge_freq),)], "unchanged boolean")


# --- training


@query(f"with {_WORDS} select unit, sum(freq)::bigint as freq from (select unnest(regexp_extract_all(word, '[^\\x00-\\x7F]')) as unit, freq from words) group by 1")
def initial_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.unit_frequencies(_words(spark, sf_dir))


@query(f"""with {_WORDS}, b as (select list_transform(regexp_extract_all(hex(encode(word)), '..'), lambda x: ('0x' || x)::int) as b, freq from words)
select z[1]::int as l, z[2]::int as r, sum(freq)::bigint as freq from (select unnest(list_zip(b[1:len(b)-1], b[2:])) as z, freq from b where len(b) > 1) group by all""")
def pair_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.pair_frequencies(_words(spark, sf_dir))


def _trainer(spark: SparkSession, sf_dir: str, steps: int = STEPS, **how) -> BpeTrainer:
    trainer = BpeTrainer(**how)
    trainer.add_inventory(_words(spark, sf_dir))
    trainer.train(256 + steps)
    return trainer


def _trained(spark: SparkSession, sf_dir: str, steps: int = STEPS, **how):
    return _trainer(spark, sf_dir, steps, **how).validate_model()


def _encoder(spark: SparkSession, sf_dir: str) -> BpeEncoder:
    return BpeEncoder.from_model(_trained(spark, sf_dir))


_RANKED = ("rank", "left_id", "right_id", "target_id", "freq")


@query(f"with recursive {_training(MANY_STEPS)} {_MERGES}")
def train_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trained(spark, sf_dir, MANY_STEPS).merges_table(spark).select(*_RANKED)


@query(f"with recursive {_training(STEPS)} {_MERGES}")
def train_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _ = distributed.train(_words(spark, sf_dir), STEPS)
    return model.merges_table(spark).select(*_RANKED)


@query(f"with recursive {_training(40, CUTOFF)} {_MERGES}")
def train_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trained(spark, sf_dir, 40, bigram_cutoff_freq=CUTOFF).merges_table(spark).select(*_RANKED)


#: Steps of Unicode training; symbols are code points, and 2 ** 21 + id for tokens. A character beyond ASCII becomes a
#: token by its frequency, before pairs as frequent; ``tokens`` are the new ones in the order of ids.
_UNICODE_STEPS = 40
_UNICODE = f"""{_WORDS},
chars as materialized (select unicode(unit) as c, sum(freq)::bigint as f from (select unnest(regexp_extract_all(word, '[^\\x00-\\x7F]')) as unit, freq from words) group by 1),
t(step, word, s, freq, tokens) as (
  select 0, word, array_to_string(list_transform(regexp_extract_all(word, '(?s).'), lambda x: '<' || lpad(cast(case when unicode(x) < 128 then 2097152 + unicode(x) else unicode(x) end as varchar), 8, '0') || '>'), ''),
    freq, cast([] as varchar[]) from words
  union all (
    with now as (select any_value(tokens) as tk from t),
    p as (select unnest(list_zip(x[1:len(x)-1], x[2:])) z, freq from (select regexp_extract_all(s, '<[0-9]+>') x, freq from t where t.step < {_UNICODE_STEPS}) where len(x) > 1),
    cand as (select 1 as kind, z[1] as l, z[2] as r, sum(freq)::bigint as f from p group by all
      union all select 0, '<' || lpad(c::varchar, 8, '0') || '>', '', f from chars, now where not list_contains(tk, chr(c))),
    best as (select *, l[2:9]::int as x, case when kind = 1 then r[2:9]::int end as y from cand order by f desc, kind, l, r limit 1),
    named as (select kind, l, r, list_transform([x, y], lambda n: case when n is null then '' when n < 2097152 then chr(n) when n < 2097408 then chr(n - 2097152) else tk[n - 2097408 + 1] end) as parts from best, now)
    select step + 1, word, case when kind = 1 then replace(s, l || r, '<' || lpad(cast(2097408 + step as varchar), 8, '0') || '>') else s end, freq, list_append(tokens, parts[1] || parts[2])
    from t, named where step < {_UNICODE_STEPS}))"""


@query(f"""with recursive {_UNICODE}
select i::int as id, right('0' || to_hex(i), 2) as token, 'byte' as kind from range(256) r(i)
union all select (255 + k)::int, hex(encode(tokens[k])), 'token' from (select tokens, unnest(range(1, len(tokens) + 1)) as k from (select any_value(tokens) as tokens from t where step = {_UNICODE_STEPS}))""")
def train_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trained(spark, sf_dir, _UNICODE_STEPS, unit="unicode").vocab_table(spark).select("id", F.hex("token").alias("token"), "kind")


@query()
def train_byte_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    trainer = BpeTrainer(unit="unicode")
    trainer.add_inventory(_words(spark, sf_dir))
    trainer.train_with_bbpe_fallback(256 + 200, primary_vocab_ratio=0.9)
    return trainer.validate_model().vocab_table(spark)


@query(f"""with recursive {_training(STEPS)},
m as materialized (select distinct step, l[2:6]::int as l, r[2:6]::int as r from t where step > 0),
v(n, tokens) as (select 0, list_transform(range(256), lambda i: right('0' || to_hex(i), 2))
  union all select n + 1, list_append(tokens, tokens[l + 1] || tokens[r + 1]) from v join m on m.step = n + 1)
select i::int as id, lower(tokens[i + 1]) as token from (select tokens, unnest(range(len(tokens))) as i from v where n = {STEPS})""")
def model_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trained(spark, sf_dir).vocab_table(spark).select("id", F.lower(F.hex("token")).alias("token"))


def _driver_dir(spark: SparkSession) -> str:
    """A new folder, in the shared one, for files that the driver writes and reads itself."""
    path = f"{_shared(spark).removeprefix('file://')}/mergeloom-{uuid.uuid4().hex}"
    if "://" in path:
        raise ValueError("this query writes plain files on the driver: spark.checkpoint.dir must be a mounted folder")
    os.makedirs(path)
    return path


@query(f"with recursive {_training(STEPS)} {_MERGES}")
def train_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One token at a time."""
    trainer = BpeTrainer()
    trainer.add_inventory(_words(spark, sf_dir))
    for _ in range(STEPS):
        trainer.step()
    return trainer.validate_model().merges_table(spark).select(*_RANKED)


# no two pairs are equally frequent among so few merges, so the tie break changes nothing
@query(f"with recursive {_training(STEPS)} {_MERGES}")
def train_largest_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trained(spark, sf_dir, tie_break="largest_content").merges_table(spark).select(*_RANKED)


@query(f"with recursive {_training(STEPS)}, x as ({_MERGES}) select rank, left_id + 3 as left_id, right_id + 3 as right_id, target_id + 3 as target_id, freq from x")
def train_after_specials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Special tokens take the first ids."""
    trainer = BpeTrainer(SPECIALS)
    trainer.add_inventory(_words(spark, sf_dir))
    trainer.train(trainer.vocab_size + STEPS)
    return trainer.validate_model().merges_table(spark).select(*_RANKED)


@query(f"with recursive {_training(STEPS)} {_MERGES}")
def model_tables_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_shared(spark)}/model-{uuid.uuid4().hex}"
    _trained(spark, sf_dir).write(spark, path)
    return M.BpeModel.read(spark, path).merges_table(spark).select(*_RANKED)


@query(f"with recursive {_training(STEPS)} {_MERGES}")
def model_files_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocab and merges files, as saved by name and found again."""
    path = _driver_dir(spark)
    _trained(spark, sf_dir).save("loom", outdir=path)
    vocab = M.load_vocab_json(M.find_file("vocab", "loom", "byte", path), "gpt2")
    merges = M.load_merges_txt(M.find_file("merges", "loom", "byte", path), "gpt2")
    return M.BpeModel("byte", vocab, tuple(merges)).merges_table(spark).select(*_RANKED)


@query(f"with recursive {_training(STEPS)}, {_TOKENS} select token, id as rank from tokens")
def rank_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's tokens through a file of ranks."""
    path = f"{_driver_dir(spark)}/loom.ranks"
    texts.dump_ranks(_trained(spark, sf_dir).vocab, path)
    return texts.rank_table(spark, f"file://{path}").select(F.lower(F.hex("token")).alias("token"), "rank")


# --- encoding


@query(f"with recursive {_training(STEPS)}, {_IDS} select word, ids from ids")
def encode_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _encoder(spark, sf_dir).encode_word_table(_words(spark, sf_dir))


_DOC_TOKENS = f"""{_IDS}, n as (select word, len(ids) as n from ids),
d as (select doc_id, lang, text, {_pieces('text')} as ps from documents),
k as (select doc_id, sum(n)::bigint as n_tokens from (select doc_id, unnest(ps) as word from d) join n using (word) group by 1)"""


@query(f"with recursive {_training(STEPS)}, {_DOC_TOKENS} select doc_id, coalesce(n_tokens, 0)::int as n_tokens from d left join k using (doc_id)")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _encoder(spark, sf_dir).encode_table(_docs(spark, sf_dir)).select("doc_id", F.size("ids").alias("n_tokens"))


@query(f"with recursive {_training(STEPS)}, {_DOC_TOKENS} select doc_id, coalesce(n_tokens, 0)::int as n_tokens from d left join k using (doc_id)")
def sql_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sqlfuncs.register(spark, _encoder(spark, sf_dir))
    _docs(spark, sf_dir).createOrReplaceTempView("mergeloom_documents")
    return spark.sql("select doc_id, bpe_count(text) as n_tokens from mergeloom_documents")


@query(f"""with recursive {_training(STEPS)}, {_DOC_TOKENS}
select lang, sum(n_tokens)::bigint as n_tokens, sum(len(text))::bigint as n_chars, sum(n_tokens)::double / sum(len(ps))::double as tokens_per_word
from d join k using (doc_id) group by lang""")
def fertility_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("lang", "text", F.size(P.words(F.col("text"))).alias("w"), F.char_length("text").alias("c"))
    encoded = _encoder(spark, sf_dir).encode_table(docs).where(F.size("ids") > 0)
    return encoded.groupBy("lang").agg(F.sum(F.size("ids")).alias("n_tokens"), F.sum("c").alias("n_chars"), (F.sum(F.size("ids")) / F.sum("w")).alias("tokens_per_word"))


@query("select doc_id, text from documents")
def decode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    enc = _encoder(spark, sf_dir)
    return enc.decode_table(enc.encode_table(_docs(spark, sf_dir).select("doc_id", "text")))


# a token of one byte beyond ASCII is one replacement character; no longer one of such bytes comes up in so few merges
@query(f"""with recursive {_training(STEPS, words=_WORDS_TOO)}, {_IDS}, {_TOKENS},
p as (select item_id, k, ps[k] as word from (select item_id, ps, unnest(range(1, len(ps) + 1)) as k from (select item_id, {_pieces('text')} as ps from benchmark))),
e as (select item_id, k, j, ids[j] as id from (select item_id, k, ids, unnest(range(1, len(ids) + 1)) as j from p join ids using (word))),
o as (select item_id, row_number() over w - 1 as pos, id, token, coalesce(sum(len(token) // 2) over (w rows between unbounded preceding and 1 preceding), 0) as start
  from e join tokens using (id) window w as (partition by item_id order by k, j))
select item_id, pos::int as pos, id, token, start::int as start from o""")
def decode_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    enc = _encoder(spark, sf_dir)
    return enc.id_columns(enc.encode_table(_docs(spark, sf_dir, "benchmark"))).select("item_id", "pos", "id", F.lower(F.hex("token")).alias("token"), "start")


@query(f"with recursive {_training(STEPS, words=_WORDS_TOO)}, {_IDS}, p as (select item_id, unnest({_pieces('text')}) as word from benchmark) select item_id, sum(len(ids))::int as n_tokens, sum(list_sum(ids))::bigint as id_sum from p join ids using (word) group by 1")
def ids_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each text through one array in a file, cut again by the numbers of tokens."""
    encoded = _encoder(spark, sf_dir).encode_table(_docs(spark, sf_dir, "benchmark"))
    path = f"{_driver_dir(spark)}/ids.npz"
    sinks.save_table_ids(encoded, path, order="item_id")
    every, at, rows = np.load(path)["idx"], 0, []
    for r in encoded.orderBy("item_id").select("item_id", F.size("ids").alias("n")).collect():
        rows.append((r.item_id, r.n, int(every[at : at + r.n].sum())))
        at += r.n
    return spark.createDataFrame(rows, "item_id long, n_tokens int, id_sum long")


@query("select item_id, text from benchmark")
def sql_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    sqlfuncs.register(spark, _encoder(spark, sf_dir), "loom")
    _docs(spark, sf_dir, "benchmark").createOrReplaceTempView("mergeloom_benchmark")
    return spark.sql("select item_id, loom_decode(loom_encode(text)) as text from mergeloom_benchmark")


@query(f"select doc_id, len(regexp_extract_all(text, '{_SPECIAL}'))::int as n_special from documents where text is not null")
def special_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Special tokens have ids of their own in encoded texts."""
    trainer = BpeTrainer(SPECIALS)
    trainer.add_inventory(PreTokenizer(SPECIALS).words(_docs(spark, sf_dir)))
    trainer.train(trainer.vocab_size + STEPS)
    encoded = trainer.finish().encode_table(_docs(spark, sf_dir).where("text is not null"))
    return encoded.select("doc_id", F.size(F.filter("ids", lambda i: i < len(SPECIALS))).alias("n_special"))


@query(f"select conv_id, turn, len({_pieces('text')})::int as n_pieces from conversations")
def conversation_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(P.tokens(F.col("text"))).alias("n_pieces"))


@query(f"select page_id, len({_pieces('html')})::int as n_pieces from pages")
def page_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "pages").select("page_id", F.size(P.tokens(F.col("html"))).alias("n_pieces"))


# --- sources and streams


@query("select text from documents where text is not null")
def parquet_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.parquet_texts(spark, f"{sf_dir}/documents.parquet")


@query("select item_id, text from (select item_id, text, sum(octet_length(encode(text))) over (order by item_id) as n from benchmark where text is not null) where n <= 20000")
def parquet_source_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.parquet_texts(spark, f"{sf_dir}/benchmark.parquet", max_bytes=20_000, order=["item_id"])


@query(f"with {_WORDS} select word, freq from words")
def stream_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = _docs(spark, sf_dir).schema
    base = _shared(spark) + f"/stream-{uuid.uuid4().hex}"
    stream = streams.text_stream(spark, f"{sf_dir}/documents.parque[t]", schema)  # a pattern: the source takes folders and patterns, not one file
    streams.accumulate_words(stream, f"{base}/counts", f"{base}/progress").awaitTermination()
    return streams.read_inventory(spark, f"{base}/counts")


@query("select text from benchmark where text <> ''")
def separated_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts through one file with separators."""
    path = f"{_shared(spark)}/sample-{uuid.uuid4().hex}"
    texts.write_sample(_docs(spark, sf_dir, "benchmark"), path)
    return texts.separated(spark, path)


@query(f"with {_WORDS} select word, freq from words")
def inventory_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory through its JSON file."""
    path = f"{_driver_dir(spark)}/words.json"
    sinks.save_inventory(_words(spark, sf_dir), path, ordered=False)
    return sinks.load_inventory(spark, path)


def _source(spark: SparkSession, sf_dir: str, name: str):
    return (r.text for r in _docs(spark, sf_dir, name).where("text is not null").select("text").toLocalIterator())


@query(f"select word, count(*) as freq from (select unnest({_pieces('text')}) as word from (select text from benchmark union all select text from conversations)) group by 1")
def word_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters fed by bounded batches of an iterator and by a table, merged."""
    one, two = PreTokenizer().word_counter(), PreTokenizer().word_counter()
    one.add_source(_source(spark, sf_dir, "benchmark"), max_records=7, max_bytes=2000)
    two.add_table(_docs(spark, sf_dir, "conversations"))
    one.merge(two)
    return one.table(spark)


@query(f"""select pair, count(*) as freq from (select substr(run, i, 2) as pair from (select run, unnest(range(1, len(run))) as i
from (select unnest(regexp_extract_all(text, '[{_L}]{{2,}}')) as run from conversations))) group by 1""")
def bigram_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    counter = PreTokenizer(script=P.LETTERS).bigram_counter()
    counter.add_table(_docs(spark, sf_dir, "conversations"))
    return counter.table(spark)


@query(f"select conv_id, turn, pos - 1 as pos, ps[pos] as piece, false as is_special from (select conv_id, turn, ps, unnest(range(1, len(ps) + 1)) as pos from (select conv_id, turn, {_pieces('text')} as ps from conversations))")
def pieces_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    sqlfuncs.register_pieces(spark, "loom_pieces")
    _docs(spark, sf_dir, "conversations").createOrReplaceTempView("mergeloom_conversations")
    return spark.sql("select conv_id, turn, pos, piece, is_special from mergeloom_conversations, lateral loom_pieces(text)")


@query('select count(value) as n, min(value) as min, median(value) as median, quantile_cont(value, 0.9) as p90, quantile_cont(value, 0.99) as p99, max(value) as max from events')
def duration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.duration_summary(_docs(spark, sf_dir, "events"), F.col("value"))


_SCRIPTS = " or ".join(f"c between {a} and {z}" for a, z in P.SCRIPT_RANGES)


@query(f"select unit, count(*) as freq from (select unnest(regexp_extract_all(text, '[^\\x00-\\x7F]')) as unit from documents) where ({_SCRIPTS.replace('c between', 'unicode(unit) between')}) = false group by 1")
def units_outside_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters beyond ASCII that are of none of the scripts written without blanks."""
    return I.unit_frequencies(_docs(spark, sf_dir).select(F.col("text").alias("word"), F.lit(1).cast("long").alias("freq"))).where(~F.col("unit").rlike(P.script_class()))


@query("""with b as (select unnest(range(256))::int as byte), s as (select byte, byte between 33 and 126 or byte between 161 and 172 or byte between 174 and 255 as shown from b)
select byte, case when shown then chr(byte) else chr((256 + sum((not shown)::int) over (order by byte) - 1)::int) end as printable from s""")
def printable_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(A.byte_to_printable().items()), "byte int, printable string")


def _file_of(spark: SparkSession, sf_dir: str, name: str) -> str:
    """The texts of a table in one file, an end mark behind each."""
    path = f"{_driver_dir(spark)}/{name}.txt"
    texts.write_joined(_docs(spark, sf_dir, name), path, P.END_OF_TEXT)
    return path


@query(f"select word, count(*) as freq from (select unnest({_pieces('text')}) as word from conversations) group by 1")
def segment_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file cut into segments at end marks, its segments counted in a table."""
    parts = segments.segment_table(spark, _file_of(spark, sf_dir, "conversations"), count=16, mode="eot")
    return PreTokenizer([P.END_OF_TEXT]).words(parts)


@query(f"select word, count(*) as freq from (select unnest({_pieces('text')}) as word from conversations) group by 1")
def file_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by segments of a size."""
    parts = segments.segment_table(spark, _file_of(spark, sf_dir, "conversations"), chunk_size=100_000, mode="eot")
    return PreTokenizer([P.END_OF_TEXT]).words(parts)


@query(f"with recursive {_training(STEPS, words=_WORDS_TOO)}, {_IDS}, p as (select unnest({_pieces('text')}) as word from benchmark) select (select sum(len(ids)) from p join ids using (word))::bigint as n_tokens, (select count(*) from benchmark) as n_ends")
def encode_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of a file, read by segments."""
    trainer = BpeTrainer([P.END_OF_TEXT])
    trainer.add_inventory(_words(spark, sf_dir))
    trainer.train(trainer.vocab_size + STEPS)
    ids = trainer.finish().encode_file(_file_of(spark, sf_dir, "benchmark"), num_chunks=8)
    return spark.createDataFrame([(int((ids != 0).sum()), int((ids == 0).sum()))], "n_tokens long, n_ends long")


@query(f"with {_WORDS} select word, freq from words")
def whole_file_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files read whole, one text each."""
    path = f"{_shared(spark)}/whole-{uuid.uuid4().hex}"
    texts.write_sample(_docs(spark, sf_dir), path)
    return PreTokenizer([P.END_OF_TEXT]).words(texts.whole_files(spark, path))
