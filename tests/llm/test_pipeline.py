"""The pipeline's stages, each on what the one before kept, against plain Python."""

import random
import struct
import zlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from foliant.llm import decontamination as leaks
from foliant.llm import toxicity
from foliant.llm.byte_bpe import parse_ranks
from foliant.llm.shared import stored, words
from foliant.llm.simhash import fingerprint
from foliant.llm.toxicity_queries import THRESHOLD
from foliant.plans.registry import QUERIES

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _place int, score double"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    draw, root = random.Random(11), str(tmp_path_factory.mktemp("tables"))
    prose = lambda n: [f"w{draw.randrange(900)}{draw.choice(['', '', ',', '.'])}" for _ in range(n)]
    items = [(i, " ".join(prose(30))) for i in range(8)]
    texts, labels = [None, "", "short", "SHORT"], []
    for i in range(110):
        own = prose(draw.choice([30, 120, 400]))
        if i % 5 == 0:
            own[len(own) // 2] = draw.choice(["nasty.", "vileness,"])
        if i % 11 == 0:
            own[5:5] = items[i % 8][1].split()
        texts.append(" ".join(own))
        if i % 7 == 0:
            texts.append(" ".join(own).upper() if i % 2 else " ".join(own))
        if i % 9 == 1 and len(own) > 300:
            texts.append(" ".join([*own[:100], "edit", *own[101:]]))
        if i % 10 == 3:
            texts.append(" ".join(own) + "\n" * (i % 3 + 1))
    rows = [(i, t, "en", "s", len(t or ""), 1, 0.5) for i, t in enumerate(texts)]
    for i, t in enumerate(texts):
        labels.append((i, 1, int(bool(t) and ("nasty" in t.lower() or "vileness" in t.lower()))))
    rows += [rows[20], (None, "no id at all", "en", "s", 3, 1, 0.5)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, rows, labels, items


def key(row):
    return (row[0] is None, row[0] or 0, row[1] or "")


def stage_rows(spark, root):
    docs, found = spark.read.parquet(f"{root}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, root), "stage")
        found.append((docs.columns, sorted(map(tuple, docs.collect()), key=key)))
    return found


def test_stages(spark, tables):
    root, rows, labels, items = tables
    found = stage_rows(spark, root)
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    assert all(columns == names for columns, _ in found[:-1])

    toxic = {i: y for i, _, y in labels}
    learnt = sorted((i, t, toxic[i]) for i, t, *_ in rows
                    if i in toxic and t is not None and zlib.crc32(str(i).encode()) % 3 != 1)
    counts = Counter(y for i, _, y in labels if zlib.crc32(str(i).encode()) % 3 != 1)
    model = toxicity.fit([r[1:] for r in learnt], toxicity.FitRule(), (counts[0], counts[1]))
    scorer = toxicity.Scorer(model)
    kept = sorted((r for r in rows if scorer.score(r[1], 0.5)[0] < THRESHOLD), key=key)
    assert found[0][1] == kept and len(kept) < len(rows)

    groups = {}
    for row in kept:
        own = (row[1] or "").lower()
        if own not in groups or (row[0] or -1) > (groups[own][0] or -1):
            groups[own] = row
    kept = sorted(groups.values(), key=key)
    assert found[1][1] == kept

    # One document of each group of fingerprints linked at two or fewer differing bits.
    prints = [int(fingerprint(words(r[1]), 3)[0]) for r in kept]
    parent = list(range(len(kept)))

    def root_of(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2:
                parent[root_of(i)] = root_of(j)
    chosen = {}
    for i, row in enumerate(kept):
        chosen[root_of(i)] = min(chosen.get(root_of(i), row), row, key=lambda r: (r[0] is None, r[0] or 0))
    left = found[2][1]
    assert left == sorted(chosen.values(), key=key) and len(left) < len(kept)

    index = leaks.ItemIndex(items, leaks.WindowRule())
    kept = [r for r in left if not index.matches(r[1])]
    assert found[3][1] == kept and len(kept) < len(left)

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = parse_ranks(file.read())
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r[0]: r[1] or "" for r in kept}
    assert len(found[4][1]) == len(kept)
    for doc_id, n, ids in found[4][1]:
        ids = list(struct.unpack(f"<{n}I", ids))
        assert ids == library.encode_ordinary(texts[doc_id])


def test_run_is_the_stages(spark, tables):
    root = tables[0]
    rows = sorted(map(tuple, corpus_pipeline.run(spark, root).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    wanted = sorted(stage_rows(spark, root)[-1][1], key=lambda r: (r[0] is None, r[0] or 0))
    assert rows == wanted


def test_empty_documents(spark, tables):
    root = tables[0]
    docs = spark.read.parquet(f"{root}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, root), "stage")
        assert docs.count() == 0


def test_the_library_does_not_need_these_operators():
    assert not any(name.startswith("op") or name == "pipeline" for name in QUERIES)
