"""The docs index built again after random edits is the one built at once, and only what was touched is parsed."""

import random

from pyspark.sql import functions as F

from sextant.operators import markdown
from sextant.plans import index
from sextant.plans.storage import Catalog
from sextant.sources.files import Config

TABLES = ("doc_source", "doc_sections", "doc_links", "frontmatters", "doc_hashes")


def files(spark, texts):
    return spark.createDataFrame([(p, t) for p, t in texts.items()], "file_path string, content string").withColumn("sha256", F.sha2("content", 256))


def rows(catalog, name):
    df = catalog.table(name)
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_after_edits_the_index_is_the_whole_one(spark, tmp_path, monkeypatch):
    dice = random.Random(11)
    names = [f"docs/{d}n{i}.md" for d in ("", "sub/") for i in range(5)]

    def text(k):
        to = [dice.choice(names).rsplit("/", 1)[-1] for _ in range(3)]
        return f"---\ntitle: T{k}\n---\n# H{k}\nsee [a]({to[0]}) and [[{to[1].removesuffix('.md')}]]\n## Sub\n[b](sub/{to[2]}) [c](../n1.md) [d](docs/n2.md)\n"

    parsed = []
    real = markdown.sections

    def sections(todo, *rest):
        parsed.append({r.file_path for r in todo.select("file_path").collect()})
        return real(todo, *rest)

    monkeypatch.setattr(markdown, "sections", sections)
    config = Config.load(None).detect(["docs"])
    texts = {n: text(i) for i, n in enumerate(names[:7])}
    kept = Catalog(spark, f"{tmp_path}/kept")
    index.build_docs_index(kept, files(spark, texts), config)
    for step in range(3):
        was = dict(texts)
        for n in dice.sample(sorted(texts), 2):
            texts.pop(n)
        for n in dice.sample(names, 2):
            texts[n] = text(100 + step)
        index.build_docs_index(kept, files(spark, texts), config)
        assert parsed[-1] == {n for n, t in texts.items() if was.get(n) != t}
        whole = Catalog(spark, f"{tmp_path}/whole{step}")
        index.build_docs_index(whole, files(spark, texts), config)
        for name in TABLES:
            assert rows(kept, name) == rows(whole, name), (step, name)
    index.build_docs_index(kept, files(spark, texts), config)
    assert parsed[-1] == set() and all(rows(kept, name) == rows(whole, name) for name in TABLES)
    assert any("target_resolved=None" not in r for r in rows(kept, "doc_links")) and any("target_resolved=None" in r for r in rows(kept, "doc_links"))


def test_a_matrix_is_read_in_parts(spark, tmp_path):
    import numpy as np
    import pytest

    from sextant.sources.files import legacy_vectors

    m = np.arange(60, dtype="<f4").reshape(20, 3)
    (tmp_path / "a.emb").write_bytes(np.array([20, 3], "<i4").tobytes() + m.tobytes())
    df = legacy_vectors(spark, f"{tmp_path}/a.emb", part=7 * 12)
    assert df.rdd.getNumPartitions() == 3 and {r.position: list(r.emb) for r in df.collect()} == {i: list(x) for i, x in enumerate(m)}
    (tmp_path / "none.emb").write_bytes(np.array([0, 3], "<i4").tobytes())
    assert legacy_vectors(spark, f"{tmp_path}/none.emb").collect() == []
    (tmp_path / "cut.emb").write_bytes(np.array([20, 3], "<i4").tobytes() + m.tobytes()[:-4])
    with pytest.raises(Exception, match="ends before row 20"):
        legacy_vectors(spark, f"{tmp_path}/cut.emb").collect()
