"""Near copies, repeated strings, vectors, components and the pipeline."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from samples import running_text

from breathline.llm import near_dup
from breathline.llm.near_dup import keep_one_of_each, least_matches, near_duplicates
from breathline.llm.repeats import remove_repeats
from breathline.llm.shared import Workspace, connected_components
from breathline.llm.vector_dup import PIECE, Forest, Shard, SmallWorld, tight_balls, vector_duplicates


def closure(ids, links):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 200 + i) for i in range(50)] + [(9, 9)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)]
    got = {r.id: r.component_id for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t")).collect()}
    real = [(a, b) for a, b in edges if a != b]
    assert got == closure({x for e in real for x in e}, real)
    assert connected_components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "t")).count() == 0


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return set(zip(*(words[k:] for k in range(4)), strict=False)) if len(words) >= 4 else ({tuple(words)} if words else set())


def test_second_components_see_linked_groups_as_one_node(spark, monkeypatch):
    from breathline.llm import near_dup

    asked = []

    def noted(edges, work):
        asked.append(edges.distinct().count())
        return connected_components(edges, work)

    monkeypatch.setattr(near_dup, "connected_components", noted)
    base = running_text(1, 120).split()
    texts = [" ".join(f"new{i}" if k == 2 * i + 5 else w for k, w in enumerate(base)) for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = near_dup.near_duplicates(df, Workspace(spark, "t"), words_each=4).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 40
    assert len(asked) == 2 and asked[1] < asked[0]


def test_near_duplicates_against_brute_force(spark, odd_documents, no_documents):
    rng = random.Random(2)
    base = [running_text(i, 60).split() for i in range(6)]
    texts = []
    for i in range(120):
        words = list(base[i % 6])
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4])):
            words[rng.randrange(len(words))] = f"new{rng.randrange(500)}"
        texts.append(" ".join(words) if i % 5 else " ".join(words).upper())
    texts += ["one two", "ONE two", "one", None, "", "one two three", *(running_text(100 + i, 50) for i in range(10))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    got = {r.doc_id: r for r in near_duplicates(df, Workspace(spark, "t"), words_each=4).collect()}
    assert {i: r.component_id for i, r in got.items()} == closure(sets, links)
    assert all(r.n_shingles == len(sets[i]) and r.kept == (i == r.component_id) for i, r in got.items())
    odd = near_duplicates(odd_documents, Workspace(spark, "t")).collect()
    assert len(odd) == odd_documents.count() and all(r.kept for r in odd)
    one = keep_one_of_each(odd_documents, Workspace(spark, "t"))
    assert one.count() == odd_documents.count() - 1 and one.columns == odd_documents.columns
    assert near_duplicates(no_documents, Workspace(spark, "t")).count() == 0


def test_a_group_of_copies_edited_in_different_places_makes_few_pairs(spark, monkeypatch):
    rng = random.Random(3)
    base = running_text(7, 150).split()
    texts = [" ".join(w if rng.random() >= 0.05 else f"{w}{rng.randrange(4)}" for w in base) for _ in range(300)]
    sets = [shingles(t) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(300), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    whole, made = near_dup.open_pairs, []

    def counted(stars, percent):
        pairs = whole(stars, percent)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(near_dup, "open_pairs", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(df, Workspace(spark, "t"), words_each=4).collect()}
    assert got == closure(range(300), links)
    assert len(set(got.values())) < 300
    assert made[0] < 300


def test_pruning_bounds_rise_and_spare_the_threshold():
    least = least_matches(0.8, 1e-6)
    assert least == sorted(least) and all(m < 0.8 * n for m, n in zip(least, range(32, 257, 32), strict=True))


def brute_repeats(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((t, bytes(np.frombuffer(t, np.uint8)[~gone]), int((np.diff(gone.astype(int), prepend=0) == 1).sum())))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_repeats_against_brute_force(spark, seed):
    rng = random.Random(seed)
    parts = [running_text(100 * seed + i, 90) for i in range(12)]
    shared = running_text(7000 + seed, 140)
    texts = []
    for i in range(12):
        at = rng.randrange(300)
        texts.append(parts[i][:at] + shared[rng.randrange(200) : rng.randrange(380, 900)] + parts[i][at:])
    texts += [texts[0], "é" * 500, "ab" * 400, "ab" * 399 + "c", "x" * 399, "x" * 400, "", shared, shared + "!" + shared]
    df = spark.createDataFrame([(i, t, i, "s") for i, t in enumerate(texts)] + [(99, None, 0, "s")], "doc_id long, text string, n long, spans string")
    got = {r.doc_id: r for r in remove_repeats(df, Workspace(spark, "t")).collect()}
    assert len(got) == len(texts) + 1 and bytes(got[99]._kept) == b""
    for i, (_, kept, spans) in enumerate(brute_repeats([t.encode() for t in texts], 400)):
        assert (hashlib.sha256(got[i]._kept).hexdigest(), len(got[i]._spans)) == (hashlib.sha256(kept).hexdigest(), spans), i


def test_repeats_in_odd_documents_and_across_chunks(spark, odd_documents, no_documents, monkeypatch):
    from breathline.llm import repeats

    got = remove_repeats(odd_documents, Workspace(spark, "t")).collect()
    assert len(got) == odd_documents.count() and all(bytes(r._kept) == b"" for r in got if r.doc_id == 8)
    assert remove_repeats(no_documents, Workspace(spark, "t")).count() == 0
    # pieces of a long text choose the same places as the text in one piece
    text = np.frombuffer((running_text(1, 3000) * 2).encode(), np.uint8)
    whole = repeats.Sampled(text, 400).place
    monkeypatch.setattr(repeats, "CHUNK", 5000)
    cut = np.concatenate([repeats.Sampled(p, 400).place[a:b] + o for o, a, b, p in repeats._pieces(text.tobytes(), 400)])
    assert (cut == whole).all()


def test_short_shared_passages_at_the_borders_of_pieces(spark, monkeypatch):
    from breathline.llm import repeats

    chunk = 2000
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    rng = random.Random(6)

    def noise(n):
        return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))

    texts, passages = [], []
    for _ in range(8):
        text = noise(4 * chunk + 700)
        for border in range(chunk, 4 * chunk + 1, chunk):
            at, size = border + rng.randrange(-40, 150), rng.randrange(130, 400)
            passages.append(text[at : at + size])
        texts.append(text)
    texts += [noise(200).join(passages[k::4]) for k in range(4)]
    long = noise(430)  # a real repeat, over a border
    texts += [noise(border - 200) + long + noise(900) for border in (chunk, 2 * chunk)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in remove_repeats(df, Workspace(spark, "t")).collect()}
    for i, (_, kept, spans) in enumerate(brute_repeats([t.encode() for t in texts], 400)):
        assert (hashlib.sha256(got[i]._kept).hexdigest(), len(got[i]._spans)) == (hashlib.sha256(kept).hexdigest(), spans), i


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    vectors = [c + rng.normal(scale=0.06, size=16) for c in centres for _ in range(12)] + list(rng.normal(size=(150, 16)))
    vectors += [vectors[0]] * 5 + [vectors[1] * 1e-3, vectors[2] * 1e200]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    rows += [(1000 + k, v) for k, v in enumerate(odd)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, dim int")
    x = np.array(vectors)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    links = [tuple(map(int, p)) for p in np.argwhere(near)] + [(1006, 1007)]
    want = closure([i for i, _ in rows], links)
    got = {r.vec_id: r for r in vector_duplicates(df, Workspace(spark, "t")).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(got[i].n_links == near[i].sum() for i in range(len(vectors)))
    assert [got[1000 + k].n_links for k in range(8)] == [0] * 6 + [1, 1] and all(r.kept == (i == r.component_id) for i, r in got.items())
    assert vector_duplicates(df.where("false"), Workspace(spark, "t")).count() == 0


def test_graph_recall_on_a_larger_shard():
    rng = np.random.default_rng(5)
    x = np.concatenate([c + rng.normal(scale=0.05, size=(30, 24)) for c in rng.normal(size=(100, 24))]).astype(np.float32)
    x = rng.permutation(x / np.linalg.norm(x, axis=1, keepdims=True))
    world = SmallWorld(x)
    beam = world.audited_beam(0.95, 16)
    found = sum(len(f) for _, f in world.within(x, 0.95, beam))
    assert found >= 0.99 * (x @ x.T >= 0.95).sum()


def test_pipeline_stages(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs, work = spark.read.parquet(f"{folder}/documents.parquet"), Workspace(spark, "t")
    columns, rows = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = work.write(stage(spark, docs, folder))
        assert docs.columns == columns and 0 < docs.count() <= rows, name
        rows = docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert pieces.select("doc_id").distinct().count() == rows
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None]


def test_pipeline_stages_on_an_empty_table(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs, work = spark.read.parquet(f"{folder}/documents.parquet").where("false"), Workspace(spark, "t")
    for _, stage in corpus_pipeline.STAGES:
        docs = work.write(stage(spark, docs, folder))
        assert docs.count() == 0


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark):
    one, other, third = (running_text(k, 40) for k in (1, 2, 3))
    near = other + " more"
    rows = [(1, one), (5, one), (5, other), (6, near), (7, third), (7, third), (8, None), (8, ""), (None, third), (None, "lone words here"), (None, "lone words here"), (9, other + " x"), (9, other)]
    docs = spark.createDataFrame([(i, t, 1, "k", 2) for i, t in rows], "doc_id long, text string, _id long, text_key string, component int")
    kept = keep_one_of_each(docs, Workspace(spark, "t"))
    assert kept.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(
        map(str, [(1, one), (5, other), (7, third), (8, None), (8, ""), (None, "lone words here")])
    )
    twins = spark.createDataFrame([(3, other), (3, near), (3, one)], "doc_id long, text string")
    left = [r.text for r in keep_one_of_each(twins, Workspace(spark, "t")).collect()]
    assert one in left and len(left) == 2


def test_no_passage_of_fifty_words_is_left_in_two_documents(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.01"
    work = Workspace(spark, "t")
    docs = work.write(keep_one_of_each(spark.read.parquet(f"{folder}/documents.parquet"), work))
    cut = corpus_pipeline.repeats_stage(spark, docs, folder)

    def shared_runs(rows):
        seen = {}
        for r in rows:
            words = r.text.split()
            for k in range(len(words) - 50):
                seen.setdefault(tuple(words[k : k + 51]), set()).add(r.doc_id)
        return sum(len(ids) > 1 for ids in seen.values())

    before, after = docs.collect(), cut.collect()
    assert shared_runs(before) > 500 and shared_runs(after) == 0 and len(after) == len(before)
    assert all(r.n_chars == len(r.text) for r in after)


def test_cuts_take_whole_characters_and_no_others(spark):
    import corpus_pipeline

    passage = "éß東京" * 40
    texts = ["� alone " + passage + " end �", "x" + passage + "y", "東 � clean", None, ""]
    docs = spark.createDataFrame([(i, t, "k", "v") for i, t in enumerate(texts)], "doc_id long, text string, _kept string, _spans string")
    got = {r.doc_id: r.text for r in corpus_pipeline.repeats_stage(spark, docs, "").collect()}
    assert got == {0: "� alone  end �", 1: "xy", 2: "東 � clean", 3: None, 4: ""}


def test_cuts_inside_characters_leave_no_halves(spark):
    rng = random.Random(8)
    letters = "aé東😀"
    passage = "".join(rng.choice(letters) for _ in range(60))
    raw = passage.encode()
    texts = ["ab" + passage + "é", "東" + passage[1:] + "x", "\U0001F601" + passage[2:] + "e"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for length in (7, 23, 50):
        rows = remove_repeats(docs, Workspace(spark, "t"), length=length, characters=True).collect()
        for r in rows:
            whole = r.text.encode()
            gone = {i for s in r._spans for i in range(s["start"], s["end"])}
            at, kept = 0, ""
            for c in r.text:
                size = len(c.encode())
                if not gone & set(range(at, at + size)):
                    kept += c
                at += size
            assert bytes(r._kept).decode() == kept and at == len(whole)
    assert len(raw) > 60


def test_vectors_in_tight_groups_are_counted_as_brute_force_counts_them(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 16))
    parts = [c + rng.normal(scale=s, size=(n, 16)) for c, n, s in zip(centres, (400, 150, 60, 30, 9, 4, 2, 1, 1, 200, 100, 80), (0.02, 0.2, 0.1, 0.05, 0.1, 0.1, 0.1, 1, 1, 0.3, 0.25, 0.01), strict=True)]
    parts.append(centres[0] * 0.97 + rng.normal(scale=0.16, size=(150, 16)))  # about the reach of the first group
    x = rng.permutation(np.concatenate(parts))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    owner = tight_balls(unit.astype(np.float32), 0.95)
    assert (owner[owner] == owner).all() and len(set(owner)) < len(x) - 300
    assert all((unit[owner == c] @ unit[owner == c].T >= 0.95).all() for c in set(owner))
    docs = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in vector_duplicates(docs, Workspace(spark, "t")).collect()}
    found, wanted = np.array([got[i].n_links for i in range(len(x))]), near.sum(axis=1)
    assert (found <= wanted).all() and (found[wanted > 0] / wanted[wanted > 0]).mean() >= 0.99
    assert {i: r.component_id for i, r in got.items()} == closure(range(len(x)), [tuple(map(int, p)) for p in np.argwhere(near)])


def test_vectors_that_share_an_id_are_judged_each_by_its_own(spark):
    rows = [(1, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [5.0, 0.0]), (None, [0.0, 3.0]), (4, [1.0, 1.0]), (4, [1.0, 1.0])]
    docs = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, node long, copies string")
    got = sorted(map(str, (tuple(r) for r in vector_duplicates(docs, Workspace(spark, "t")).collect())))
    assert got == sorted(map(str, [(1, 2, 1, True), (1, 1, 1, True), (2, 2, 1, False), (3, 1, 1, False), (None, 2, 1, True), (4, 1, 4, True), (4, 1, 4, True)]))


def test_a_shard_of_vectors_is_built_and_asked_in_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(12)
    x = rng.normal(size=(6000, 64)).astype(np.float32)
    x[3000:] = x[:3000] + rng.normal(scale=0.02, size=(3000, 64)).astype(np.float32)
    ids, copies = np.arange(6000), np.ones(6000, np.int64)
    tracemalloc.start()
    shard = Shard(ids, copies, x, 0.95, 48)
    pieces = shard.packed()
    built = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # the graph holds the vectors once, as they came, and is cut into rows of bounded size
    assert max(map(len, pieces)) <= PIECE and sum(map(len, pieces)) < x.nbytes + 6000 * 160
    assert built < 40 * 10**6  # an audit that held all its similarities twice took more
    asked = Shard.unpacked(pieces, 0.95)
    unit = asked.unit[np.argsort(asked.ids)]
    counts, edges = asked.links_of(ids[:200], unit[:200])
    assert (counts == 1).all() and {tuple(e) for e in edges} == {(i, i + 3000) for i in range(200)}


def test_a_dense_group_leaves_a_forest_not_its_pairs():
    forest = Forest()
    for i in range(200):
        forest.add(i, np.arange(200))
    assert len(forest.edges) == 199
