import hashlib
import os
import random
import subprocess
import sys

import numpy as np

import corpus_pipeline
from ledgerlight.llm import byte_bpe

from .test_dedup import joined, sets_of, strip


def test_pipeline_brute_force(spark, frame, tmp_path):
    r = random.Random(9)
    word = lambda: "".join(r.choice(["an", "bo", "ciu", "der", "en"]) for _ in range(r.randrange(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(20)) for i in range(3)]
    rows = [(i, text(50), "en") for i in range(80)]
    rows += [(100 + i, rows[i][1] + " \n", "en") for i in range(5)] + [(0, rows[0][1], "en")]
    rows += [(200 + i, rows[10 + i][1] + " " + word(), "en") for i in range(5)]
    rows += [(300 + i, text(20) + " " + items[i][1].upper() + " " + text(20), "en") for i in range(3)]
    rows += [(400, None, "en"), (401, "12 34", "en"), (402, "", None)]
    frame(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = [(d, t) for d, t, _ in rows if t and any(c.isalpha() for c in t)]
    best = {}
    for d, t in kept:
        c = strip(t)
        best[c] = min(best.get(c, (1, 0, "")), (-len(t), d, t))
    kept = [(d, t) for _, d, t in best.values()]
    part = joined(sets_of(kept))
    kept = [(d, t) for d, t in kept if part[d] == d and not any(s.lower() in t.lower() for _, s in items)]
    assert len(kept) == 80

    from ledgerlight.llm.shared import folder

    shared = os.path.dirname(folder(spark).removeprefix("file:"))
    before = set(os.listdir(shared))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(set(os.listdir(shared)) - before) == 1  # the last stage's input
    assert sorted((x.doc_id, x.decoded_sha256) for x in got) == sorted((d, hashlib.sha256(t.encode()).hexdigest()) for d, t in kept)
    codec = byte_bpe.codec(byte_bpe.rank_file())
    texts = dict(kept)
    for x in got:
        assert codec.decode(np.array(x.ids)).tobytes().decode() == texts[x.doc_id] and x.n_tokens == len(x.ids)


def test_stages_keep_the_columns(spark, frame, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = frame([(i, f"some words here {i}", "en") for i in range(12)])
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard", "decontaminate", "byte_bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 12


def test_pipeline_edges(spark, frame, tmp_path):
    """Null identifiers, repeats, a very long text, texts without words or language, and empty tables."""
    r = random.Random(4)
    word = lambda: "".join(r.choice(["an", "bo", "ciu", "der", "en"]) for _ in range(r.randrange(1, 4)))
    long, own, other = (" ".join(word() for _ in range(n)) for n in (60_000, 40, 40))
    rows = [(1, long, "en"), (2, own, "en"), (2, own, "en"), (None, other, "en"), (None, own + "\n", None), (-5, None, "en"), (None, None, None), (3, "\t \n", None), (4, "!!! 12", "en")]
    frame(rows).write.parquet(f"{tmp_path}/a/documents.parquet")
    frame([]).write.parquet(f"{tmp_path}/b/documents.parquet")
    for name, items in (("a", [(None, None), (7, ""), (7, "words of no document at all")]), ("b", [])):
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    got = sorted(((x.doc_id is None, x.doc_id, x.decoded_sha256) for x in corpus_pipeline.run(spark, f"{tmp_path}/a").collect()), key=str)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    # of the equal texts that with a line feed more is longer
    assert got == sorted([(False, 1, sha(long)), (True, None, sha(other)), (True, None, sha(own + "\n"))], key=str)
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").collect() == []


def test_the_rest_stands_alone(tmp_path):
    """Without this subpackage and the pipeline the entry file still gives the other queries."""
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    script = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith(('ledgerlight.llm', 'corpus_pipeline')): raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        f"sys.path.insert(0, {root!r})\n"
        "import __spark_entry__ as e\n"
        "assert len(e.queries()) > 40 and not any(n.startswith('op') for n in e.queries()) and 'pipeline' not in e.queries()\n"
    )
    subprocess.run([sys.executable, "-c", script], check=True, cwd=tmp_path)
