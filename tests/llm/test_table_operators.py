"""Archives, duplicates, near duplicates, shards, addresses and the language model."""

import base64
import hashlib
import math
import os
import random
import uuid
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import binary_trie, brown_classes, warc
from foliant.llm.binary_trie import Forest, near_pairs, trie_links
from foliant.llm.block_names import exact_duplicates
from foliant.llm.components import components
from foliant.llm.near_duplicates import NearRule, near_components, similar
from foliant.llm.path_templates import TemplateRule, judge_urls
from foliant.llm.shared import stored, words
from foliant.llm.simhash import fingerprint
from foliant.llm.similar_sets import set_links
from foliant.llm.uniform_shards import hypergeometric, matrix_row, uniform_shards
from foliant.runtime import shared_dir


def lowered(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


# -- archives ----------------------------------------------------------------

def test_archives_come_back(spark, tmp_path):
    rows = [
        (1, None, None, 7), (2, "http://a b", "", 7), (3, "u", "x\r\n\r\nWARC/1.1\r\n" * 400, 7),
        (4, "u", "é" * 3000, 7), (5, "v", "same", 7), (6, "v", "same", 7), (7, "w", "é" * 3000, 7),
        (None, "v", "no key", 7),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, segment int")
    path = str(tmp_path / "warc")
    warc.write_archives(pages, path, segment_bytes=500, records_per_file=3)
    assert warc.read_records(spark, path).filter("segment IS NOT NULL").count() > 10
    records = stored(warc.read_archives(spark, path), "records")
    found = {r.page_id: r for r in warc.page_records(records).collect()}
    bodies = {i: (html or "").encode() for i, _, html, _ in rows}
    last = {body: max((i for i, b in bodies.items() if b == body), key=lambda i: i or 0)
            for body in bodies.values()}
    assert set(found) == set(bodies)
    for i, body in bodies.items():
        row = found[i]
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert (row.payload_bytes, row.payload_digest, row.sound) == (len(body), digest, True)
        assert (row.type, row.refers_to) == (
            ("response", None) if last[body] == i else ("revisit", last[body]))
    payloads = {bytes(r.payload) for r in records.filter("type = 'response'").collect()}
    assert payloads == set(bodies.values())


def test_every_row_is_a_record(spark, tmp_path):
    long, other = "a" * 3000, "b" * 2500
    rows = [(1, long), (1, long), (2, other), (2, long), (2, ""), (2, None), (None, long), (None, "x"),
            (None, "x"), (None, None), (-5, other)]
    schema = "page_id long, html string, url string, sound int, record_type string, key int, row int, keep int"
    pages = spark.createDataFrame([(*r, "u", 1, "t", 2, 3, 4) for r in rows], schema)
    warc.write_archives(pages, str(tmp_path / "w"), segment_bytes=700)
    found = warc.page_records(stored(warc.read_archives(spark, str(tmp_path / "w")), "records")).collect()
    want = Counter()
    for i, html in rows:
        body = (html or "").encode()
        keep = max((j for j, h in rows if (h or "") == (html or "") and j is not None), default=None)
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        kind = ("response", None) if keep == i else ("revisit", keep)
        want[i, len(body), digest, *kind, True] += 1
    assert want == Counter(
        (r.page_id, r.payload_bytes, r.payload_digest, r.type, r.refers_to, r.sound) for r in found)
    empty = spark.createDataFrame([], schema)
    warc.write_archives(empty, str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


def test_small_payloads_are_all_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"), minimum_bytes=3)
    assert warc.read_records(spark, str(tmp_path / "w")).filter("type = 'revisit'").count() == 0


def test_broken_segments_are_marked(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "z" * 4000)], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"), segment_bytes=1000)
    records = warc.read_records(spark, str(tmp_path / "w"))
    assert warc.reassembled(records).filter("complete").count() == 1
    for damage in ("segment != 2", "segment != 1", "total IS NULL"):
        assert warc.reassembled(records.filter(damage)).filter("complete").count() == 0
    again = warc.reassembled(records.unionByName(records))
    assert again.count() == 1 and again.filter("complete").count() == 1


def test_framing():
    for body in (b"", b"x" * 10, bytes(range(256)) * 99):
        assert warc.dechunked(warc.chunked(body, 7)) == body
    assert warc.dechunked(b"4\r\nab") is None and warc.dechunked(b"zz\r\n") is None


# -- duplicates --------------------------------------------------------------

@pytest.mark.parametrize("block", [3, 2048])
def test_exact_duplicates(spark, block):
    draw = random.Random(2)
    texts = [None, "", "A", "a", "É", "é", "abcabc", "ABCabc", "abcab", "abcabcabcabc", "ab" * 3000]
    texts += ["".join(draw.choice("aAb") for _ in range(draw.randrange(12))) for _ in range(150)]
    rows = list(enumerate(texts)) + [(None, "A"), (None, "only"), (2, "A"), (7, "other")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, name int")
    found = exact_duplicates(docs, block_bytes=block).collect()
    groups = defaultdict(list)
    for i, text in rows:
        groups[hashlib.sha256(lowered(text).encode()).hexdigest()].append(i)
    assert Counter((r.doc_id, r.text_sha256) for r in found) == Counter(
        (i, sha) for sha, ids in groups.items() for i in ids)
    kept = Counter(r.text_sha256 for r in found if r.kept)
    assert kept == Counter(groups.keys())
    for row in found:
        ids = groups[row.text_sha256]
        keep = max((i for i in ids if i is not None), default=None)
        assert (row.keep_id, row.group_size) == (keep, len(ids))
        assert not row.kept or row.doc_id == keep


def test_exact_duplicates_of_nothing(spark):
    assert exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_components(prints, budget):
    names = list(range(len(prints)))

    def top(i):
        while names[i] != i:
            i = names[i]
        return i

    for i, own in enumerate(prints):
        for j in np.flatnonzero(np.bitwise_count(prints ^ own) <= budget).tolist():
            a, b = top(i), top(j)
            names[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(prints))]


def test_near_pairs_once_each():
    draw = np.random.default_rng(0)
    base = draw.integers(0, 2**63, 60, dtype=np.uint64)
    near = [base ^ (np.uint64(1) << draw.integers(0, 64, 60).astype(np.uint64)) for _ in range(5)]
    keys = np.sort(np.concatenate([base, *near, np.zeros(4, np.uint64)]))
    found = [(int(a), int(b)) for i, j in near_pairs(keys, None, 0, 0, 2) for a, b in zip(i, j)]
    wanted = {(i, j) for i in range(len(keys)) for j in range(i + 1, len(keys))
              if int(keys[i] ^ keys[j]).bit_count() <= 2}
    assert len(found) == len(set(found)) and set(found) == wanted


@pytest.mark.parametrize("keys_per_group", [8, 10_000])
def test_trie_links_connect_all(spark, keys_per_group):
    draw = np.random.default_rng(1)
    hub = np.uint64(0x0123456789ABCDEF)
    near = [hub ^ np.uint64((1 << int(a)) | (1 << int(b))) for a, b in draw.integers(0, 64, (40, 2))]
    keys = np.unique(np.concatenate([draw.integers(0, 2**63, 60, dtype=np.uint64), np.array(near)]))
    items = stored(spark.createDataFrame(
        [(i, int(k)) for i, k in enumerate(keys.view(np.int64))], "id long, key long"), "keys")
    found = {r.a: r.b for r in components(trie_links(items, keys_per_group=keys_per_group)).collect()}
    assert [found.get(i, i) for i in range(len(keys))] == brute_components(keys, 2)


def test_near_components(spark):
    draw = random.Random(6)
    base = [[f"w{draw.randrange(500)}" for _ in range(400)] for _ in range(12)]
    texts = [None, "", "   ", "a", "A", "a b"]
    for own in base:
        for _ in range(6):
            copy = list(own)
            for _ in range(draw.randrange(3)):
                copy[draw.randrange(400)] = "edited"
            texts.append("\t ".join(copy))
    rows = list(enumerate(texts)) + [(3, "again"), (None, texts[10]), (None, "a c e")]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, id int")
    prints = np.array([fingerprint(words(t), 3)[0] for _, t in rows])
    roots = brute_components(prints, 2)
    least = {}
    for root, (i, _) in zip(roots, rows):
        least[root] = min((x for x in (least.get(root), i) if x is not None), default=None)
    wanted = Counter(
        (i, (int(p.view(np.int64)),), least[root]) for (i, _), p, root in zip(rows, prints, roots))
    found = near_components(docs, keys_per_group=16).collect()
    assert Counter((r.doc_id, tuple(r.prints), r.component_id) for r in found) == wanted
    loose = near_components(docs, similar(0.8)).collect()
    assert len({r.component_id for r in loose if r.doc_id and r.doc_id >= 6}) == len(base)


def test_near_components_of_nothing(spark):
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert near_components(nothing, NearRule()).count() == 0


def test_fingerprint_by_definition():
    import xxhash

    for text in ("", "a", "a b", "a b c", "the cat the cat the cat sat", "é " * 50):
        own = words(text)
        runs = [b" ".join(own[i : i + 3]) for i in range(max(1, len(own) - 2))] if own else []
        counts = [sum(xxhash.xxh64_intdigest(r, 42) >> b & 1 for r in runs) for b in range(64)]
        assert int(fingerprint(own, 3)[0]) == sum(
            1 << b for b in range(64) if 2 * counts[b] > len(runs))


# -- shards ------------------------------------------------------------------

def test_shards_are_exact(spark):
    rows = [(i % 90, None if i % 7 == 0 else f"t{i % 90}", i) for i in range(103)] + [(None, "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot int").repartition(5)
    for per_bucket in (4, 1000):
        found = uniform_shards(docs, 9, rows_per_bucket=per_bucket).collect()
        assert Counter((r.doc_id, r.text) for r in found) == Counter((a, b) for a, b, _ in rows)
        by_shard = defaultdict(list)
        for row in found:
            by_shard[row.shard].append(row.slot)
        assert sorted(len(s) for s in by_shard.values()) == [11] * 4 + [12] * 5
        assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert uniform_shards(docs.limit(0), 9).count() == 0


def test_shards_are_uniform(spark):
    docs = spark.range(0, 60, 1, 6).selectExpr("id AS doc_id", "'' AS text")
    seen = Counter()
    for seed in range(12):
        seen.update((r.doc_id // 10, r.shard) for r in uniform_shards(docs, 3, seed=seed).collect())
    # 40 expected in each of 18 cells, with a deviation of about 5.
    assert all(20 <= seen[part, shard] <= 60 for part in range(6) for shard in range(3))


def test_the_matrix_has_its_margins():
    until, sizes = np.cumsum([0, 5, 0, 7, 30, 58]), np.array([20, 30, 50])
    matrix = np.array([matrix_row(3, until, sizes, p) for p in range(5)])
    assert matrix.sum(0).tolist() == [20, 30, 50] and matrix.sum(1).tolist() == [5, 0, 7, 30, 58]
    rng = np.random.default_rng(1)
    large = [hypergeometric(rng, 600_000_000, 900_000_000, 1000) for _ in range(2000)]
    assert abs(np.mean(large) - 400) < 2 and abs(np.var(large) / 240 - 1) < 0.15


# -- addresses ---------------------------------------------------------------

RULES = [("block", "bad.com", "/"), ("allow", "bad.com", "/ok/"), ("block", "mix.org", "/ads/")]


def test_addresses(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://Sub.BAD.com", "x://bad.com/ok/1?q", "x://notbad.com/ok/1",
            "x://mix.org/ads/77#f", "x://mix.org", "x://h?q/a", "x://h/a//b/" + "c/" * 3000]
    urls += [f"x://mix.org/ads/{i}" for i in range(40)] + [f"x://mix.org/news/{i}.html" for i in range(40)]
    urls += [f"x://many.net/slug-{i}" for i in range(60)]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)],
                                  "page_id long, url string, template string")
    found = {r.page_id: r for r in judge_urls(pages, RULES).collect()}
    assert len(found) == len(urls)
    assert (found[0].host, found[0].path, found[0].rule) == ("", "", None)
    assert (found[4].host, found[4].path, found[4].rule, found[4].verdict) == (
        "sub.bad.com", "", None, found[4].verdict)
    assert (found[5].rule, found[5].verdict) == ("bad.com/ok/", "allow")
    assert found[6].rule is None and found[9].host == "h" and found[9].path == ""
    assert (found[7].rule, found[7].verdict) == ("mix.org/ads/", "block")
    assert {found[i].template for i in range(11, 51)} == {found[7].template}
    assert len({r.template for r in found.values() if r.host == "many.net"}) == 1
    assert judge_urls(pages.limit(0), RULES).count() == 0


def test_a_template_takes_its_labels_verdict(spark):
    # Rules see only part of a template; the rest of it is judged by that part.
    urls = [f"x://a.com/shop/{i}/buy" for i in range(1000, 1060)] + [f"x://a.com/wiki/page{i}" for i in range(60)]
    rules = [("block", "a.com", f"/shop/10{d}") for d in range(4)] + [("allow", "a.com", "/wiki/page1")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = judge_urls(pages, rules, TemplateRule(strength=2)).filter("rule IS NULL").collect()
    verdicts = {(r.path.split("/")[1], r.verdict) for r in rows}
    assert verdicts == {("shop", "block"), ("wiki", "allow")}


def test_unlabelled_rows_follow_their_neighbourhood(spark):
    """Branch, then host, then domain: what is known nearby decides where a template has no labels."""
    urls = [f"x://bad.site.com/spam/{i}" for i in range(30)] + ["x://bad.site.com/about"] * 3
    urls += [f"x://good.site.com/news/{i}" for i in range(30)] + ["x://good.site.com/about"] * 3
    urls += ["x://new.worse.org/a", "x://new.other.org/a"] + [f"x://old.worse.org/p/{i}" for i in range(40)]
    urls += [f"x://mix.net/{kind}/{i}" for kind in ("good", "bad", "none") for i in range(40)]
    rules = [("block", "bad.site.com", "/spam/"), ("allow", "good.site.com", "/news/"),
             ("block", "old.worse.org", "/"), ("block", "mix.net", "/bad/"), ("allow", "mix.net", "/good/"),
             ("allow", "fine.org", "/")]
    urls += [f"x://fine.org/{i}" for i in range(60)]
    pages = spark.createDataFrame([(i, u, 1, 2) for i, u in enumerate(urls + urls)],
                                  "page_id long, url string, share long, form int")
    rows = judge_urls(pages, rules).filter("rule IS NULL").collect()
    verdicts = {(r.host, r.path.split("/")[1]): r.verdict for r in rows}
    assert verdicts["bad.site.com", "about"] == "block"
    assert verdicts["good.site.com", "about"] == "allow"
    assert verdicts["new.worse.org", "a"] == "block" and verdicts["new.other.org", "a"] == "allow"
    templates = {(r.host, r.path.split("/")[1]): r.template for r in judge_urls(pages, rules).collect()}
    assert templates["mix.net", "good"] != templates["mix.net", "bad"]


@pytest.mark.parametrize("sf", ["0.01"])
def test_rows_without_a_rule_get_both_verdicts(spark, sf):
    from foliant.llm.url_queries import RULES as OWN

    pages = spark.read.parquet(f"/root/testdata/sf{sf}/pages.parquet")
    found = judge_urls(pages, OWN).filter("rule IS NULL").groupBy("verdict").count().collect()
    assert {r.verdict for r in found} == {"allow", "block"}


# -- language model ----------------------------------------------------------

@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(7)
    texts = [None, "", "rare once"] + [
        " ".join(f"{kind}{min(int(draw.expovariate(0.3)), 20)}" for kind in "abab" * draw.randrange(20))
        for _ in range(120)]
    return texts, spark.createDataFrame(
        [(i, t, i % 5 != 4, "x") for i, t in enumerate(texts)],
        "doc_id long, text string, training boolean, numbers string")


def small_model(docs):
    rule = brown_classes.ClassRule(classes=4, clustered=10, frequent=25, rounds=2, smoothing=4.0)
    return brown_classes.train(docs, "training", rule)


def test_base_scores(corpus):
    texts, docs = corpus
    counts = Counter()
    for i, text in enumerate(texts):
        if i % 5 != 4:
            counts.update([*words(text), None])
    total, types = sum(counts.values()), len(counts)
    for row in brown_classes.scores(small_model(docs), "doc_id").collect():
        own = [*words(texts[row.doc_id]), None]
        base = sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in own)
        assert (row.n_tokens, row.n_known, row.train_tokens) == (
            len(own), sum(counts[w] > 0 for w in own), total)
        assert row.base_score == pytest.approx(base) and row.score <= 0
        assert row.perplexity == pytest.approx(10 ** (-row.score / row.n_tokens))


def test_probabilities_add_up_to_one(corpus):
    model = small_model(corpus[1])
    t, others = model.tables, model.others.collect()
    rare = len(t.counts) - 2
    for history in range(len(t.transition)):
        if history == 4 and not len(others):
            continue
        chance = 10.0 ** t.transition[history]
        within = 10.0 ** -t.emission
        words_part = sum(
            chance[t.predicted[w]] * (t.counts[w] - t.discount) * within[t.predicted[w]]
            for w in range(rare))
        others_part = sum(chance[r["class"]] * (r.n - t.discount) * within[r["class"]] for r in others)
        assert words_part + others_part + chance[5] + 10.0 ** t.unseen[history] == pytest.approx(1.0)


def test_the_model_beats_the_base_on_held_out_texts(corpus):
    rows = brown_classes.scores(small_model(corpus[1]), "doc_id", "training").filter("NOT training")
    sums = rows.agg(F.sum("score"), F.sum("base_score")).first()
    assert sums[0] > sums[1]


def test_exchange_moves_words_to_their_kind():
    k = 2
    left, right = np.zeros((20, 4)), np.zeros((20, 4))
    own = np.arange(20) // 10  # two kinds that always alternate
    left[np.arange(20), 1 - own], right[np.arange(20), 1 - own] = 50, 50
    wrong = own.copy()
    wrong[3] = 1
    pairs = np.zeros((4, 4), dtype=np.int64)
    np.add.at(pairs, wrong, right.astype(np.int64))
    assert brown_classes.exchanged(left, right, wrong, pairs, k)[3] == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b", False), (2, None, False)], "doc_id long, text string, training boolean")
    rows = brown_classes.scores(small_model(docs), "doc_id").collect()
    assert len(rows) == 2 and all(math.isfinite(r.score) and r.n_known == 0 for r in rows)
    assert brown_classes.scores(small_model(docs.limit(0)), "doc_id").count() == 0


def test_similar_joins_every_slice():
    assert sorted(similar(0.8).slices()) == [(n, at) for n in range(8) for at in (0, 32)]


def jaccard(a, b):
    one, two = (set(zip(*(words(t)[i:] for i in range(5)))) for t in (a, b))
    return len(one & two) / len(one | two)


@pytest.mark.parametrize("elements_per_group", [600, 1 << 22])
def test_similar_is_the_jaccard_of_sets(spark, elements_per_group):
    draw = random.Random(8)
    prose = lambda n: [f"w{draw.randrange(5000)}" for _ in range(n)]
    line = prose(12)
    texts = [" ".join(line * 40 + prose(60)) for _ in range(4)]  # one repeated line, little else
    base = prose(200)
    texts += [" ".join(base), " ".join(base + base[:5] * 60)]  # 0.8 as sets, not as multisets
    for n in (0, 5, 10, 15, 20, 25, 30):  # beyond 0.8 and below
        texts += [" ".join(base[: 200 - 2 * n] + prose(2 * n)) for _ in range(3)]
    parent = list(range(len(texts)))
    top = lambda i: i if parent[i] == i else top(parent[i])
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = near_components(docs, similar(0.8), elements_per_group=elements_per_group).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: top(i) for i in range(len(texts))}


def test_set_links_against_brute_force():
    draw = np.random.default_rng(3)
    sets = [np.unique(draw.integers(0, 14, 12)) for _ in range(60)]
    for joined in (np.zeros(60, bool), np.arange(60) % 9 == 0):
        i, j = set_links(np.concatenate(sets), np.array([len(s) for s in sets]), joined, 0.8)
        parent = Forest(60)
        parent.join(i, j)
        wanted = Forest(60)
        for a in range(60):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if joined[a] & joined[b] or both / (len(sets[a]) + len(sets[b]) - both) >= 0.8:
                    wanted.join(np.array([a]), np.array([b]))
        assert (parent.roots(np.arange(60)) == wanted.roots(np.arange(60))).all()


def test_a_crowd_on_one_slice_makes_no_large_group(spark, monkeypatch):
    """Distinct wide fingerprints that share a slice, in groups of at most so many rows."""
    draw = np.random.default_rng(5)
    wide = draw.integers(0, 2**62, (300, 2), dtype=np.uint64)
    wide[:200, 0] = (wide[0, 0] >> np.uint64(32) << np.uint64(32)) | (wide[:200, 0] & np.uint64(0xFFFFFFFF))
    wide[200, 0] = wide[0, 0] ^ np.uint64(1 << 40)  # near the crowd
    wide[201] = wide[202] ^ np.uint64(1 << 50)  # near one another, far from the crowd
    items = stored(spark.createDataFrame(
        [(i, int(w[0]), [int(x) for x in w]) for i, w in enumerate(wide.view(np.int64))],
        "id long, key long, wide array<long>"), "wide-keys")
    seen = str(shared_dir(spark)) + "/group-sizes-" + uuid.uuid4().hex
    os.makedirs(seen)
    plain = binary_trie.near_pairs

    def watched(a, b, *rest):
        size = len(a) + (0 if b is None else len(b))
        open(f"{seen}/{size}-{uuid.uuid4().hex}", "w").close()
        return plain(a, b, *rest)

    monkeypatch.setattr(binary_trie, "near_pairs", watched)
    found = {r.a: r.b for r in components(trie_links(
        items, bits=32, budget=3, radius=20, keys_per_group=64, crowd=32)).collect()}
    assert {i for i in range(300) if found.get(i, i) == 0} == set(range(201))
    assert found[202] == 201 and not {i for i in found if i > 202}
    assert max(int(name.split("-")[0]) for name in os.listdir(seen)) <= 64


def test_only_the_first_bits_of_a_key_count(spark):
    rows = [(0, 7 << 40, [0]), (1, (7 << 40) | 0x7FFFFFFF, [0]), (2, 0x7FFF << 40, [0])]
    items = stored(spark.createDataFrame(rows, "id long, key long, wide array<long>"), "keys")
    assert [tuple(r) for r in trie_links(items, bits=32, budget=3, radius=1).collect()] == [(1, 0)]
