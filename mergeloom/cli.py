"""``python -m mergeloom.cli train|encode``: train a model on a corpus, encode a corpus with a model."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from mergeloom.operators.encoder import BpeEncoder
from mergeloom.operators.pretokenizer import PreTokenizer
from mergeloom.operators.trainer import BpeTrainer
from mergeloom.plans.model import TrainStepError
from mergeloom.sources import sinks, texts


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="mergeloom")
    sub = p.add_subparsers(dest="command", required=True)
    t = sub.add_parser("train", help="count words, train, write vocab and merges")
    t.add_argument("input")
    t.add_argument("--column", default="text", help="text column of Parquet input")
    t.add_argument("--out", default=".")
    t.add_argument("--name", default="model")
    t.add_argument("--vocab-size", type=int, required=True)
    t.add_argument("--unit", choices=("byte", "unicode"), default="byte")
    t.add_argument("--specials", help="file with one special token a line")
    t.add_argument("--eot", default="<|endoftext|>")
    t.add_argument("--cutoff", type=int)
    t.add_argument("--tie-break", choices=("smallest_pair_id", "largest_content"))
    t.add_argument("--alphabet", choices=("raw", "byte_level"))
    t.add_argument("--primary-ratio", type=float, help="Unicode part of a byte-fallback training")
    e = sub.add_parser("encode", help="encode texts with a model")
    e.add_argument("input")
    e.add_argument("output", help=".npy or .npz for one array, else a Parquet folder")
    e.add_argument("--column", default="text")
    e.add_argument("--model-dir", default=".")
    e.add_argument("--name", default="model")
    e.add_argument("--unit", choices=("byte", "unicode"), default="byte")
    e.add_argument("--specials")
    e.add_argument("--eot", default="<|endoftext|>")
    return p


def _read(spark: SparkSession, path: str, column: str, eot: str) -> DataFrame:
    if path.rstrip("/").endswith(".parquet"):
        return texts.parquet_texts(spark, path, column)
    return texts.separated(spark, path, eot)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("mergeloom").getOrCreate()
    specials = texts.special_tokens_file(a.specials) if a.specials else [a.eot]
    docs = _read(spark, a.input, a.column, a.eot)
    metrics = sinks.Metrics()
    if a.command == "train":
        out = Path(a.out)
        counts = out / f"_words.{a.name}.json"
        if counts.exists():
            words = sinks.load_inventory(spark, counts)
        else:
            with metrics.timed("count"):
                words = PreTokenizer(specials, a.eot).words(docs)
                sinks.save_inventory(words, counts)
                words = sinks.load_inventory(spark, counts)
        trainer = BpeTrainer(specials, unit=a.unit, initial_alphabet=a.alphabet, tie_break=a.tie_break, bigram_cutoff_freq=a.cutoff)
        trainer.add_inventory(words)
        with metrics.timed("train"):
            try:
                if a.primary_ratio is not None:
                    trainer.train_with_bbpe_fallback(a.vocab_size, primary_vocab_ratio=a.primary_ratio)
                else:
                    trainer.train(a.vocab_size)
            except TrainStepError as e:
                print(f"warning: {e}", file=sys.stderr)
        trainer.save(a.name, outdir=out)
        metrics.gauge("vocab_size", trainer.vocab_size)
        metrics.save(out / f"metrics.{a.name}.json")
        return 0
    encoder = BpeEncoder.load(a.name, unit=a.unit, input_dir=a.model_dir, special_tokens=specials)
    encoded = encoder.encode_table(docs)
    if a.output.endswith((".npy", ".npz")):
        sep = np.array([encoder.special_ids[a.eot]] if a.eot in encoder.special_ids else [], np.uint32)
        parts = [x for r in encoded.toLocalIterator(prefetchPartitions=True) for x in (np.array(r.ids, np.uint32), sep)]
        sinks.save_ids(np.concatenate(parts) if parts else np.zeros(0, np.uint32), a.output)
    else:
        encoded.write.mode("overwrite").parquet(a.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
