"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from symtransfer.llm.bpe import tokenizer_path
from symtransfer.llm.common import remove, shared_folder
from symtransfer.llm.exact_dedup import keep_one
from symtransfer.llm.packing import packed_documents
from symtransfer.llm.pii import DEMO_KEY, pseudonymise
from symtransfer.llm.quality import keep_good
from symtransfer.llm.simhash import keep_one_similar


def quality_rules(spark, docs, sf_dir):
    """Documents that the quality rules reject go."""
    return keep_good(docs)


def exact_dedup(spark, docs, sf_dir):
    """One document of each group of equal texts stays."""
    return keep_one(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each group of similar texts (five-word shingles, 0.8 or more) stays."""
    return keep_one_similar(docs)


def surrogates(spark, docs, sf_dir):
    """Personal data and secrets become surrogates; n_chars stays, as it tells of the original."""
    return pseudonymise(docs, DEMO_KEY, n_col=None)


def packing(spark, docs, sf_dir):
    """Tokenised pieces and their places in sequences."""
    return packed_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("pii_surrogates", surrogates),
    ("packing", packing),
]
#: Tokenisation, automata and components have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage over the written rows of the one before; earlier stages' rows go once the next ones are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/corpus_pipeline/{uuid.uuid4()}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}_{name}")
            docs = spark.read.parquet(f"{folder}/{k}_{name}")
            if k:
                remove(spark, f"{folder}/{k - 1}_{STAGES[k - 1][0]}")
    return docs
