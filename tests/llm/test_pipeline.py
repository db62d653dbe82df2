"""The corpus pipeline against plain versions of its stages, and the registered queries of this subpackage."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from fixtures import corpus, frame, prose
from labelspark.llm import queries, quality, token_ids
from test_near import plain as near_groups

QUESTION = "How many of the 14 baskets does Maria carry to the market if she sells 3 of them on the way and gives 2 to her neighbour"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(7)
    rows = corpus(1, 200) + [(500 + k, prose(rng, 20) + ". " + QUESTION.replace("14", str(20 + k))) for k in range(4)]
    rows += [(600 + k, " ".join(w.upper() + "!!" for w in prose(rng, 60).split())) for k in range(150)]
    labels = [(doc, int(doc < 600), 0) for doc, text in rows if text and doc % 2 == 0]
    folder = str(tmp_path_factory.mktemp("tables"))
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, QUESTION), (2, prose(rng, 20))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows


def test_run_matches_plain_stages(spark, tables):
    folder, rows = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    scored = quality.score(docs, quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))).toPandas()
    left = dict(rows)
    poor = set(scored.doc_id[scored.predicted == 0])
    assert len(poor & set(range(600, 750))) > 120 and len(poor - set(range(600, 750))) < 20
    left = {d: t for d, t in left.items() if d not in poor}
    last = {}
    for d, t in left.items():
        last[t or ""] = max(last.get(t or "", d), d)
    left = {d: t for d, t in left.items() if last[t or ""] == d}
    left = {d: left[d] for d, _, _, kept in near_groups(list(left.items())) if kept}
    left = {d: t for d, t in left.items() if "baskets does Maria carry" not in (t or "")}
    pieces = corpus_pipeline.run(spark, folder).toPandas()
    assert set(pieces.doc_id) == set(left)
    tokenizer = Tokenizer.from_file(token_ids.default_path())
    for doc, part in pieces.groupby("doc_id"):
        whole = tokenizer.encode(left[doc] or "", add_special_tokens=False).ids + [1]
        part = part.sort_values("start")
        assert part.ids_crc32.tolist() == [
            zlib.crc32(np.array(whole[a : a + n], dtype="<u4").tobytes()) for a, n in zip(part.start, part.length, strict=True)
        ]
        assert part.length.sum() == len(whole)


def test_stages_keep_the_columns(spark, tables):
    folder, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns


def test_every_operator_is_registered():
    names = set(entry.queries())
    assert "pipeline" in names
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()} == set(range(1, 14))
    assert set(queries.ORACLE) <= set(queries.QUERIES)
