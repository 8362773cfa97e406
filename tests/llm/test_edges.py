"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for the operators that need no more than that."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import byte_bpe, common, decontaminate, licenses, line_dedup, mixing, ngram_join, quality_neighbours, quality_rules, repeats, token_align, token_counts, toxicity

#: Columns named like those that the operators use inside.
SCHEMA = "doc_id long, text string, source string, id string, h string, tok string, cls string, n string, component string, rh string, w string, weight string, copies string, __id string, __removed string, removed string, rh_ string, lost string, gone string, at string, mix_turn string, mix_copies string, src string, own string, x string"
LONG = " ".join(f"w{k % 7919}" for k in range(60_000)) + "\n" + "same words here\n" * 3000
ROWS = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, LONG), (6, "a b c d e f"), (6, "a b c d e f"), (6, "other text of the same id"), (7, "ß 日本 \U0001f600")]


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, None if i == 4 else "s", *["x"] * 22) for i, t in rows], SCHEMA)


def operators(spark):
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(1, 8)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "never in any text at all here"), (2, None)], "item_id long, text string")

    def scored(m):
        return lambda d: d.select("doc_id", m.score(F.col("text"), m.train(docs(spark), labels)).alias("s"))

    return {
        "repeats": repeats.remove,
        "toxicity": scored(toxicity),
        "neighbours": scored(quality_neighbours),
        "mixing": mixing.mix,
        "mixture": mixing.mixture_of,
        "lines": line_dedup.report,
        "clean lines": line_dedup.clean,
        "tokens": token_counts.count_documents,
        "rules": quality_rules.judge,
        "benchmark": lambda d: decontaminate.report(d, items),
        "licences": licenses.scan,
        "join": ngram_join.join,
        "bytes": byte_bpe.encode_documents,
        "align": token_align.align,
    }


def test_every_row_has_a_result_and_empty_tables_none(spark):
    d = docs(spark)
    for name, op in operators(spark).items():
        got = op(d)
        assert got.count() == len(ROWS), name
        assert sorted(x[0] for x in got.select("doc_id").collect()) == sorted(i for i, _ in ROWS), name
        assert op(d.limit(0)).count() == 0, name


def test_repeated_rows_score_alike(spark):
    d = docs(spark)
    for name, op in operators(spark).items():
        if name in ("toxicity", "neighbours", "rules", "licences", "tokens", "benchmark"):
            rows = [tuple(x) for x in op(d.where("text = 'a b c d e f'")).collect()]
            assert rows[0] == rows[1], name


def test_a_cluster_needs_a_shared_folder(spark):
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://somewhere"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        common.shared_dir(Session())


def test_voting_ties():
    # Four labelled vectors, three equally near: all three vote though two are asked for.
    m = quality_neighbours.Model(None, None, np.array([[1, 0], [1, 0], [1, 0], [0, 1]], np.float32), np.array([1, 0, 0, 1], np.float32))
    assert quality_neighbours.vote(np.array([[1, 0]], np.float32), m, voters=2)[0] == pytest.approx(1 / 3)
