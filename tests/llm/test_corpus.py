"""Corpus-wide operators against brute force and on odd inputs."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tests_llm import ODD_TEXTS, SF01, rows_of

from check import compare, database
from tracebeam.llm import lm_score, mixing, near_dup, oracle, quality, sharding, toxicity
from tracebeam.llm.common import components
from tracebeam.llm.queries import queries

DOCS = rows_of("documents", SF01)


def docs_of(spark):
    return spark.read.parquet(f"{SF01}/documents.parquet")


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_matches_sql_on_the_larger_tables(spark, name):
    outcome, _ = compare(spark, database(SF01), queries()[name], oracle.SQL[name], SF01)
    assert outcome.startswith("ok"), outcome


# -- components -----------------------------------------------------------------------------------


def brute_components(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    return {x: find(x) for x in root}


@pytest.mark.parametrize("shape", ["random", "path", "star", "none"])
def test_components(spark, shape):
    rng = random.Random(3)
    pairs = {
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)],
        "path": [(k, k + 1) for k in range(150)], "star": [(999, k) for k in range(200)], "none": [],
    }[shape]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    assert got == brute_components((a, b) for a, b in pairs if a != b)


# -- near-duplicates ------------------------------------------------------------------------------


def brute_near_dup(docs, size, percent=80):
    sets = {}
    for doc, text in docs:
        if doc is not None:
            sets.setdefault(doc, set()).update(near_dup.shingle_set(near_dup.word_list(text), size))
    owners = defaultdict(list)
    for doc, s in sets.items():
        for x in s:
            owners[x].append(doc)
    both = Counter((a, b) for group in owners.values() for a in group for b in group if a < b)
    links = [(a, b) for (a, b), n in both.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    roots = brute_components(links)
    return {doc: (len(s), roots.get(doc, doc)) for doc, s in sets.items()}


def crowd(n, seed=1):
    """Variants of one text: a chain and a crowd of near copies, some just outside."""
    rng = random.Random(seed)
    base = [f"t{rng.randrange(5000)}" for _ in range(160)]
    out = []
    for k in range(n):
        words = list(base)
        for _ in range(rng.randrange(8)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
        out.append((1000 + k, " ".join(words)))
    return out


@pytest.mark.parametrize("block", [8, 256])
def test_near_duplicates_equal_brute_force(spark, make_docs, block):
    docs = crowd(150) + [(k, f"only {k} of its kind " * 3) for k in range(20)] + [(40, "a b c"), (41, "A b  c"), (42, "a b")]
    got = near_dup.near_duplicates(make_docs(docs), 4, block=block, dense=16)
    want = brute_near_dup(docs, 4)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == want
    assert 1 < len({c for _, c in want.values()}) < len(docs)


def test_crowd_of_unlinked_texts_writes_no_pairs(make_docs, monkeypatch):
    """Texts just below the threshold of each other: rows of pairs grow with the texts, not their square."""
    rng = random.Random(5)
    base = [f"t{k}" for k in range(400)]
    docs = []
    for k in range(120):
        words = list(base)
        for at in rng.sample(range(0, 400, 5), 7):
            words[at] = f"v{k}x{at}"
        docs.append((k, " ".join(words)))
    pairs = []
    whole = near_dup.confirmed
    monkeypatch.setattr(near_dup, "confirmed", lambda p, *rest: (pairs.append(p.count()), whole(p, *rest))[1])
    got = near_dup.near_duplicates(make_docs(docs), 4)
    want = brute_near_dup(docs, 4)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == want
    assert len({c for _, c in want.values()}) > 20
    assert sum(pairs) <= 2 * len(docs)


def test_near_duplicates_five_words_on_the_tables(spark):
    got = near_dup.near_duplicates(docs_of(spark)).collect()
    want = brute_near_dup([(r[0], r[1]) for r in DOCS], 5)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_near_duplicates_of_odd_texts(make_docs):
    got = near_dup.near_duplicates(make_docs(ODD_TEXTS), 4).collect()
    rows = {r["doc_id"]: r for r in got}
    assert len(got) == len(ODD_TEXTS)
    assert rows[1]["n_shingles"] == 0 and rows[1]["kept"] and rows[2]["kept"] and rows[3]["component_id"] == 3
    assert rows[5]["component_id"] == 4 and not rows[5]["kept"]
    assert rows[None]["component_id"] is None and rows[None]["kept"]
    assert near_dup.near_duplicates(make_docs([]), 4).count() == 0
    stage = near_dup.near_dup_stage(make_docs(ODD_TEXTS))
    assert stage.columns == make_docs(ODD_TEXTS).columns
    assert sorted(r["doc_id"] or 0 for r in stage.collect()) == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10]


def test_near_dup_stage_judges_rows_not_ids(make_docs):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    docs = make_docs([(1, a), (1, a), (2, a), (2, b), (3, c), (None, a), (None, b + " more"), (None, "z"), (9, None), (9, "")])
    stage = near_dup.near_dup_stage(docs)
    assert stage.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in stage.collect()), key=repr)
    assert got == sorted([(1, a), (2, b), (3, c), (None, "z"), (9, None), (9, "")], key=repr)


# -- quality --------------------------------------------------------------------------------------


def test_quality_of_odd_texts(make_docs):
    docs = make_docs(ODD_TEXTS + [(20, "a b c d e f a b c d e g h i j k l m n o p q r s t u", None, None)])
    rows = {r["doc_id"]: r for r in quality.quality_rules(docs).collect()}
    assert rows[1]["n_words"] == 0 and rows[1]["base_failed"] and not rows[1]["kept"]
    assert rows[20]["n_repeat_words"] == 10 and rows[20]["base_failed"]
    assert quality.quality_rules(make_docs([])).count() == 0
    stage = quality.quality_stage(docs)
    assert stage.columns == docs.columns
    assert {r["doc_id"] for r in stage.collect()} == {d for d, r in rows.items() if r["kept"]}


def test_fences_follow_the_group(make_docs):
    plain = [(k, f"word{k} " * 3 + "many other words in a text of this kind", "en", "a") for k in range(300)]
    loud = [(1000 + k, f"#word{k} *x $y %z many & other | words < in > a text", "en", "b") for k in range(300)]
    odd = [(5000, "#word *x $y %z many & other | words < in > a text", "en", "a")]
    rows = {r["doc_id"]: r["kept"] for r in quality.quality_rules(make_docs(plain + loud + odd)).collect()}
    assert all(rows[k] for k in range(300)) and all(rows[1000 + k] for k in range(300)) and not rows[5000]


def test_quality_stage_judges_rows_not_ids(make_docs):
    good = "many words in a text that passes all of the rules for text {}"
    docs = make_docs(
        [(None, good.format(k)) for k in range(5)] + [(None, "too short"), (None, None)]
        + [(7, good.format(7)), (7, ""), (8, good.format(8))]
    ).selectExpr("*", "1 n_words", "2 base_failed", "map('a', 1) _limits")
    out = quality.quality_stage(docs)
    assert out.columns == docs.columns
    want = [tuple(r) for r in docs.collect() if len((r["text"] or "").split()) > 9]
    assert len(want) == 7 and sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)


# -- scores ---------------------------------------------------------------------------------------


def is_held(doc):
    return zlib.crc32(str(doc).encode()) % 7 == 2


def brute_base(docs):
    low = [(d, (t or "").encode().translate(lm_score._LOWER).split() + [None]) for d, t in docs]
    counts = Counter(w for d, ws in low if not is_held(d) for w in ws)
    n, v = sum(counts.values()), len(counts)
    return n, {
        d: (len(ws), sum(counts[w] > 0 for w in ws), sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
        for d, ws in low
    }


def brute_ppm(training, text):
    """Log10 probability by counting contexts directly, escapes by method C with exclusion."""
    follow = defaultdict(Counter)
    for t in training:
        raw = b"\0\0" + lm_score.lowered(t) + b"\0"
        for k in range(2, len(raw)):
            for order in range(3):
                follow[raw[k - order : k]][raw[k]] += 1
    raw, total = b"\0\0" + lm_score.lowered(text) + b"\0", 0.0
    for k in range(2, len(raw)):
        p, gone = 1.0, set()
        for order in (2, 1, 0, -1):
            seen = follow[raw[k - order : k]] if order >= 0 else Counter(range(256))
            seen = {s: c for s, c in seen.items() if s not in gone}
            if not seen:
                continue
            last = order < 0 or len(seen) + len(gone) == 256
            size = sum(seen.values()) + (0 if last else len(seen))
            if raw[k] in seen:
                p *= seen[raw[k]] / size
                break
            p *= len(seen) / size
            gone |= set(seen)
        total += math.log10(p)
    return total


@pytest.mark.parametrize("head", [400_000, 50, 0])
def test_base_scores_equal_brute_force(spark, head):
    docs = [(r[0], r[1]) for r in DOCS]
    n, want = brute_base(docs)
    got = lm_score.score(docs_of(spark), head).collect()
    assert len(got) == len(docs)
    for r in got:
        tokens, known, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (tokens, known, n, is_held(r["doc_id"]))
        assert r["base_score"] == pytest.approx(base, rel=1e-9)


def test_model_scores_equal_brute_force(make_docs):
    rng = random.Random(2)
    docs = [(k, " ".join(rng.choice(["alpha", "beta", "gämma", "x"]) for _ in range(rng.randrange(12)))) for k in range(40)]
    docs += [(99, None), (100, ""), (101, "zzz unseen Q")]
    training = [t for d, t in docs if not is_held(d)]
    for r in lm_score.score(make_docs(docs)).collect():
        assert r["score"] == pytest.approx(brute_ppm(training, dict(docs)[r["doc_id"]]), rel=1e-5)


@pytest.mark.parametrize("head_grams", [lm_score.HEAD_GRAMS, 30, 0])
def test_model_of_five_bytes_equals_brute_force_also_with_nul_bytes(make_docs, head_grams):
    order, rng = 5, random.Random(3)
    docs = [(k, " ".join(rng.choice(["alpha", "alphabet", "gämma", "x\0y", "\0"]) for _ in range(rng.randrange(12)))) for k in range(40)]
    docs += [(99, None), (100, ""), (101, "zzz alphabex unseen"), (102, "\0\0"), (5, docs[5][1]), (None, "alpha \0")]
    low = lambda t: [lm_score.START] * order + list(lm_score.lowered(t)) + [lm_score.END]
    follow = defaultdict(Counter)
    for t in [t for d, t in docs if d is None or not is_held(d)]:
        raw = low(t)
        for k in range(order, len(raw)):
            for n in range(order + 1):
                follow[tuple(raw[k - n : k])][raw[k]] += 1

    def brute(t):
        raw, total = low(t), 0.0
        for k in range(order, len(raw)):
            p, gone = 1.0, set()
            for n in range(order, -2, -1):
                seen = follow[tuple(raw[k - n : k])] if n >= 0 else Counter(range(256))
                seen = {s: c for s, c in seen.items() if s not in gone}
                size = sum(seen.values()) + (len(seen) if n >= 0 else 0)
                if raw[k] in seen:
                    p *= seen[raw[k]] / size
                    break
                p *= len(seen) / size if seen else 1.0
                gone |= set(seen)
            total += math.log10(p)
        return total

    rows = lm_score.score(make_docs(docs), order=order, head_grams=head_grams).collect()
    want = sorted((d or -1, brute(t)) for d, t in docs)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"] or -1, r["score"]) for r in rows)
    assert [d for d, _ in got] == [d for d, _ in want]
    assert [x for _, x in got] == pytest.approx([x for _, x in want], rel=1e-9)


def test_long_texts_keep_their_context_between_pieces(monkeypatch):
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 7)
    texts = [b"abc", b"", b"a text of more than seven bytes", b"x" * 7]
    found = defaultdict(list)
    for owner, grams in lm_score.pieces(texts, 3):
        for o, g in zip(owner.tolist(), grams.tolist()):
            found[o].append(g.to_bytes(4, "big"))
    for k, t in enumerate(texts):
        whole = bytes([lm_score.START]) * 3 + t + bytes([lm_score.END])
        assert found[k] == [whole[i : i + 4] for i in range(len(t) + 1)]


def test_model_probabilities_add_up():
    cells = np.array([0x616263, 0x616264, 0x626364, 0x000061], np.int32)
    model = lm_score.ByteModel(cells, np.array([3, 1, 5, 2]))
    table = 10.0 ** model.table.reshape(-1, 256).astype(np.float64)
    assert np.allclose(table.sum(axis=1), 1, atol=1e-5)
    text = b"abcd" * 700_000
    assert model.score(text) == pytest.approx(sum(model.table[model.row[a] * 256 + b] * n for (a, b), n in Counter(
        zip((np.frombuffer(b"\0\0" + text, np.uint8)[:-1].astype(int) << 8) | np.frombuffer(b"\0\0" + text, np.uint8)[1:],
            text + b"\0")).items()), rel=1e-5)


def test_held_out_text_beats_the_base_on_average(spark):
    rows = [r for r in lm_score.score(docs_of(spark)).collect() if r["held_out"]]
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in rows)


def test_scores_of_odd_texts(make_docs):
    got = lm_score.score(make_docs(ODD_TEXTS)).collect()
    assert sorted(Counter(r["doc_id"] or 0 for r in got).items()) == sorted(Counter(d or 0 for d, _ in ODD_TEXTS).items())
    assert lm_score.score(make_docs([])).count() == 0


# -- mixing ---------------------------------------------------------------------------------------


def test_mixing_matches_sql_on_a_skewed_corpus(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, "w " * rng.randrange(30), "en", "big" if k < 700 else f"s{k % 5}") for k in range(1000)]
    rows += [(2000, None, None, None), (2001, "a b", None, None), (2002, "", "en", "empty"), (2003, "x y", "en", "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    df.coalesce(1).write.parquet(str(tmp_path / "d"))
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    outcome, _ = compare(spark, con, lambda s, d: mixing.mixed(s.read.parquet(d)), oracle.mixing_sql(mixing.ENTROPY), str(tmp_path / "d"))
    assert outcome.startswith("ok"), outcome
    used = mixing.mixed(df).groupBy("source").sum("n_tokens").collect()
    natural = Counter()
    for _, t, _, s in rows:
        natural[s] += len((t or "").split())
    total = sum(natural.values())
    shares = {r[0]: r[1] / total for r in used}
    assert shares["big"] < natural["big"] / total - 0.05
    assert shares["tiny"] * total <= mixing.REPEATS * natural["tiny"]
    stage = mixing.mixing_stage(df)
    assert stage.columns == df.columns and stage.count() == mixing.mixed(df).count()


@pytest.mark.parametrize("entropy", [0.5, 0.998])
def test_mixing_is_the_same_for_every_partitioning(spark, entropy):
    def uses(df):
        return sorted((r["doc_id"], r["epoch"], r["place"]) for r in mixing.mixed(df, entropy).collect())

    docs = docs_of(spark)
    wanted = uses(docs)
    for n in (1, 13):
        assert uses(docs.repartition(n)) == wanted
    if entropy < 0.99:  # the tables' own mix is flat enough: every document once
        assert [d for d, _, _ in wanted] == sorted(r[0] for r in DOCS)


def test_natural_mix_of_thirds_loses_nothing(spark):
    rows = [(k, "w " * (1 + k % 3), "en", f"s{k % 7}") for k in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert mixing.mixing_stage(df, 0.0).count() == 700


def test_mixing_of_odd_texts(make_docs):
    docs = make_docs(ODD_TEXTS)
    assert mixing.mixing_stage(docs).columns == docs.columns
    assert mixing.mixed(make_docs([])).count() == 0
    assert mixing.mixed(make_docs([(1, None), (2, "")])).count() == 2


# -- sharding -------------------------------------------------------------------------------------


def check_shards(rows, texts, shards):
    sizes = Counter(r["shard"] for r in rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        text = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(text) + 8 and r["text_crc32"] == zlib.crc32(text) and r["law"] == "rows"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [sizes[s] for s in range(shards)]
    assert set(sizes) <= set(range(shards)) and max(counts) - min(counts) <= 1
    return sizes


def test_shards_are_even_and_keep_groups(spark):
    rows = sharding.shard(docs_of(spark)).collect()
    texts = {r[0]: r[1] for r in DOCS}
    assert len(rows) == len(DOCS)
    check_shards(rows, texts, 24)
    groups = defaultdict(set)
    for r in rows:
        groups[texts[r["doc_id"]]].add(r["shard"])
    assert sum(len(g) > 1 for g in groups.values()) <= 23


def test_a_hot_group_is_split_evenly(make_docs):
    docs = [(k, "the same text") for k in range(500)] + [(1000 + k, f"pair {k // 2}") for k in range(600)]
    rows = sharding.shard(make_docs(docs)).collect()
    texts = dict(docs)
    check_shards(rows, texts, 24)
    pairs = defaultdict(set)
    for r in rows:
        if r["doc_id"] >= 1000:
            pairs[texts[r["doc_id"]]].add(r["shard"])
    assert sum(len(p) > 1 for p in pairs.values()) <= 23


def test_shards_of_odd_texts(make_docs):
    rows = sharding.shard(make_docs(ODD_TEXTS)).collect()
    check_shards(rows, dict(ODD_TEXTS), 24)
    assert sharding.shard(make_docs([])).count() == 0


def test_labels_travel_over_links(spark, make_docs):
    # no two rows share a text; within 40 communities of 12 rows, hubs of four overlap
    rng = random.Random(6)
    docs = [(k, f"text {k}") for k in range(480)]
    hubs = [(c, j, d) for c in range(40) for j in range(10) for d in rng.sample(range(12 * c, 12 * c + 12), 4)]
    links = spark.createDataFrame([(d, f"{c}-{j}") for c, j, d in hubs], "doc_id long, hub string")
    apart = {}
    for rounds in (0, 5):
        rows = sharding.shard(make_docs(docs), 8, rounds, links).collect()
        check_shards(rows, dict(docs), 8)
        label = {r["doc_id"]: r["label"] for r in rows}
        assert max(Counter(label.values()).values()) <= 75  # even share 60
        seen = defaultdict(set)
        for c, j, d in hubs:
            seen[c, j].add(label[d])
        apart[rounds] = sum(len(x) - 1 for x in seen.values())
    assert apart[5] < 0.7 * apart[0], apart


def test_groups_within_one_shard_stay_whole_and_huge_ones_are_one_run(make_docs):
    docs = [(k, f"group {k // 36}") for k in range(288)] + [(1000 + k, "huge") for k in range(100)]
    docs += [(2000 + k, f"alone {k}") for k in range(572)]
    rows = sharding.shard(make_docs(docs)).collect()
    check_shards(rows, dict(docs), 24)
    groups = defaultdict(list)
    for r in rows:
        groups[dict(docs)[r["doc_id"]]].append((r["shard"], r["slot"], r["label"]))
    places = sorted(40 * s + slot for s, slot, _ in groups["huge"])
    assert places == list(range(100))
    for k in range(8):
        assert len({label for _, _, label in groups[f"group {k}"]}) == 1
        at = sorted(40 * s + slot for s, slot, _ in groups[f"group {k}"])
        assert at == list(range(at[0], at[0] + 36))
    counts = Counter(r["label"] for r in rows)
    assert max(counts[k] for k in range(24)) <= 60


# -- toxicity -------------------------------------------------------------------------------------


def test_chain_finds_held_out_toxic_rows(spark):
    docs = docs_of(spark)
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    rows = labels.collect()
    train = labels.where("doc_id % 3 <> 0").selectExpr("doc_id", "1 - quality low_quality", "toxic")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, train).collect()}
    held = [r for r in rows if r["doc_id"] % 3 == 0]
    right = sum(got[r["doc_id"]]["toxic"] == bool(r["toxic"]) for r in held)
    assert len(got) == len(DOCS) and right >= 0.93 * len(held)


def test_toxicity_of_odd_texts(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, low_quality int, toxic int")
    assert not any(r["toxic"] for r in toxicity.toxicity(make_docs(ODD_TEXTS), none).collect())
    one = spark.createDataFrame([(4, 0, 1), (5, 0, 1), (None, 1, 1), (6, None, 0)], "doc_id long, low_quality int, toxic int")
    got = toxicity.toxicity(make_docs(ODD_TEXTS), one).collect()
    assert len(got) == len(ODD_TEXTS) and not any(r["low_quality"] for r in got)
    assert toxicity.toxicity(make_docs([]), one).count() == 0


# -- pipeline -------------------------------------------------------------------------------------


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline

    docs = docs_of(spark)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF01).cache()
        assert docs.columns == columns, name
        assert docs.count() != before.count(), name
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF01).collect()
    assert len(rows) == docs.count() and len({r["shard"] for r in rows}) == 24
