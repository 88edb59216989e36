"""The training-data operators against brute force, round trips and edge cases."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from terravox.llm import byte_bpe, chat, components, decontaminate, fingerprints, html_text, jaccard, registry, sentence_spans, sharding, toxicity, training_order, words

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, stops=True):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "", "."] if stops else [""]) + str(rng.randrange(50)) * (rng.random() < 0.5) for _ in range(n))


def table(spark, texts):
    rows = [(i if not isinstance(t, tuple) else t[0], t if not isinstance(t, tuple) else t[1]) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t)) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    """Texts with exact and near copies, a hot passage, empty, null, short and long ones."""
    rng = random.Random(11)
    base = [prose(rng, rng.randrange(1, 160)) for _ in range(60)]
    passage = prose(rng, 60)
    texts = list(base)
    for t in base[:20]:
        w = t.split(" ")
        for _ in range(3):
            v = list(w)
            v[rng.randrange(len(v))] = "changed" + str(rng.randrange(99))
            texts.append(" ".join(v))
    texts += base[:5] + ["", None, "   ", "one", "one two three", "one two three", prose(rng, 4000)]
    texts += [prose(rng, 20) + "\n" + passage + "\n" + prose(rng, 20) for _ in range(12)]
    return texts


# words


def test_words_are_those_of_the_patterns(corpus):
    for kind, pattern in ((words.SPACED, rb"[^\x20\x09-\x0D]+"), (words.ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        seen = {}
        texts = pa.array([t or "" for t in corpus] + ["ÀB1-x　y\x00z", "\t\n", "a"])
        for lo, hi, data, off in words.chunks(texts, 3000):
            w = words.words(data, off, kind)
            for i in range(hi - lo):
                raw = re.sub(rb"[A-Z]", lambda m: m[0].lower(), texts[lo + i].as_py().encode())
                want = re.findall(pattern, raw)
                got = w.hashes[w.first[i] : w.first[i + 1]].tolist()
                assert len(got) == len(want)
                assert all(seen.setdefault(h, x) == x for h, x in zip(got, want, strict=True))
        assert len(set(seen.values())) == len(seen)


# 5: n-gram Jaccard join


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute_groups(texts, percent=80):
    s = [shingles(t) for t in texts]
    parent = list(range(len(s)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(s[i]), root(i)) for i in range(len(s))}


def test_jaccard_groups_are_brute_force(spark, corpus):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(table(spark, corpus)).collect()}
    assert got == brute_groups(corpus)


@pytest.mark.parametrize("frequent", [False, True])
def test_jaccard_of_many_fragments(spark, corpus, monkeypatch, frequent):
    """More fragments than one deal makes, and n-grams that are known to be frequent, change nothing."""
    monkeypatch.setattr(jaccard, "FRAGMENT_GRAMS", 20 if frequent else 0.12)
    monkeypatch.setattr(jaccard, "FIRST_BITS", 3)
    if frequent:
        monkeypatch.setattr(jaccard, "SAMPLED_OFTEN", 4)
        docs = table(spark, corpus).select("doc_id", "text")
        assert len(jaccard.frequent_grams(docs, len(corpus), 5)) > 40
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(table(spark, corpus)).collect()}
    assert got == brute_groups(corpus)


def test_jaccard_of_text_ids(spark, corpus):
    named = table(spark, corpus).withColumn("doc_id", F.concat(F.lit("d"), F.format_string("%05d", "doc_id")))
    got = {int(r.doc_id[1:]): (r.n_shingles, int(r.component_id[1:])) for r in jaccard.jaccard_groups(named).collect()}
    assert got == brute_groups(corpus)


def test_jaccard_of_many_near_copies(spark):
    """A large family whose members link only partly: every link counts, none is lost to the choice of leaders."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(150):
        v = list(base)
        for _ in range(rng.randrange(0, 4)):
            v[rng.randrange(60)] = f"n{rng.randrange(8)}"
        texts.append(" ".join(v))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(table(spark, texts)).collect()}
    assert got == brute_groups(texts)


def test_jaccard_with_several_fragments(spark, corpus, monkeypatch):
    monkeypatch.setattr(jaccard, "FRAGMENT_GRAMS", 500)
    monkeypatch.setattr(jaccard, "TASK_GRAMS", 700)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(table(spark, corpus)).collect()}
    assert got == brute_groups(corpus)


def test_jaccard_edges(spark):
    assert jaccard.jaccard_groups(table(spark, [])).count() == 0
    rows = jaccard.jaccard_groups(table(spark, [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, None)]).withColumn("node", F.lit(1)).withColumn("entries", F.lit(2))).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in rows) == [(-1, 2, 7), (7, 2, 7), (7, 2, 7), (9, 0, 9)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(5, 5), (129, 40)] + [(200, 201), (201, 200)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got.values()) == {0, 200} and got[129] == 0 and got[201] == 200
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 4: decontamination


def brute_contamination(texts, items, size=13):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = cut(t)
        k = min(size, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[a : a + k])].add(str(i))
    out = []
    for t in texts:
        w = cut(t)
        hit, found = set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if (g := tuple(w[a : a + k])) in windows:
                    hit |= set(range(a, a + k))
                    found |= windows[g]
        out.append((len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def items_of(corpus):
    rng = random.Random(5)
    return [(1, " ".join(corpus[3].split()[:30])), (12, prose(rng, 40, False)), (2, "one TWO, three"), (3, "one"), (4, ""), (5, None), (6, corpus[-1].split("\n")[1])]


@pytest.mark.parametrize("block", [1 << 20, 1])
def test_contamination_is_brute_force(spark, corpus, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    items = items_of(corpus)
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = table(spark, corpus).withColumn("items", F.lit("clash"))
    got = decontaminate.contamination(docs, bench).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got] == brute_contamination(corpus, items)
    kept = decontaminate.contamination(docs, bench, remove="documents")
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in enumerate(brute_contamination(corpus, items)) if not r[3]}
    for r in decontaminate.contamination(docs, bench, remove="both").collect():
        assert brute_contamination([r.text], [x for x in items if x[0] not in (2, 3)])[0][1] == 0


def test_contamination_edges(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit) for r in decontaminate.contamination(table(spark, ["a b", None]), none).orderBy("doc_id").collect()] == [(2, 0), (0, 0)]
    assert decontaminate.contamination(table(spark, []), none).count() == 0


# 6: sentence spans


def brute_pieces(raw, found):
    """First words of the pieces of one text: behind stops, and in each window without one at the word of least value."""
    w = words.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), words.SPACED)
    value = [0, *words.mix(w.hashes[1:] ^ (w.hashes[:-1] * np.uint64(0xA24BAED4963EE407))).tolist()]
    heads = {0} | {k + 1 for k in range(len(found) - 1) if raw[found[k][1] - 1 : found[k][1]] in (b".", b"!", b"?")}
    cuts = set(heads)
    for i in range(len(found) - sentence_spans.PIECE_WORDS + 1):
        window = range(i, i + sentence_spans.PIECE_WORDS)
        if not heads & set(window):
            cuts.add(min(window, key=lambda k: (value[k], -k)))
    return sorted(cuts) if found else []


def brute_without_repeats(texts, shifted=False):
    """Runs by their words, in order of id and place; what a later occurrence covers goes."""
    docs = []
    for t in texts:
        raw = (t or "").encode()
        found = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
        low = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), raw[a:b]) for a, b in found]
        units, first = [], 0
        for k in range(len(found)):
            last = k + 1 == len(found) or raw[found[k][1] - 1 : found[k][1]] in (b".", b"!", b"?") or re.search(rb"[\r\n]", raw[found[k][1] : found[k + 1][0]])
            if last or k - first + 1 == sentence_spans.SENTENCE_WORDS:
                units.append((first, k + 1))
                first = k + 1
        if shifted:
            heads = brute_pieces(raw, found)
            units = list(zip(heads, [*heads[1:], len(found)], strict=False))
        runs = set()
        for i in range(len(units)):
            for j in range(i + sentence_spans.RUN_SENTENCES - 1, len(units)):
                if units[j][1] - units[i][0] >= sentence_spans.RUN_WORDS:
                    runs.add((i, j))
                    break
        for j in range(len(units)):
            for i in range(j - sentence_spans.RUN_SENTENCES + 1, -1, -1):
                if units[j][1] - units[i][0] >= sentence_spans.RUN_WORDS:
                    runs.add((i, j))
                    break
        docs.append((raw, found, low, units, runs))
    seen, gone = {}, [set() for _ in docs]
    for d, (_, _, low, units, runs) in enumerate(docs):
        for i, j in sorted(runs):
            if seen.setdefault(tuple(low[units[i][0] : units[j][1]]), (d, i)) != (d, i):
                gone[d] |= set(range(i, j + 1))
    out = []
    for (raw, found, _, units, _), g in zip(docs, gone, strict=True):
        starts = [0 if k == 0 else found[u[0]][0] for k, u in enumerate(units)] + [len(raw)]
        kept = b"".join(raw[starts[k] : starts[k + 1]] for k in range(len(units)) if k not in g)
        out.append((raw if not g else kept.rstrip() if len(units) - 1 in g else kept).decode())
    return out, [len(g) for g in gone]


@pytest.mark.parametrize("shifted", [False, True])
@pytest.mark.parametrize(("size", "bits"), [(2_000_000, 12), (300, 12), (0.02, 3)])  # the last: more than 16 bits, dealt twice
def test_repeats_are_brute_force(spark, corpus, size, bits, shifted, monkeypatch):
    monkeypatch.setattr(sentence_spans, "FRAGMENT_RUNS", size)
    monkeypatch.setattr(sentence_spans, "TASK_RUNS", max(size, 300))
    monkeypatch.setattr(sentence_spans, "FIRST_BITS", bits)
    texts = [*corpus, corpus[0] + "\n" + corpus[0]]
    got = sentence_spans.without_repeats(table(spark, texts).withColumn("n_removed", F.lit("clash")).withColumn("_spans", F.lit(1)).withColumn("__key", F.lit(2)), shifted=shifted)
    assert {"_spans", "__key"} <= set(got.columns)
    got = got.orderBy("doc_id").collect()
    want, counts = brute_without_repeats(texts, shifted)
    assert [r.n_removed for r in got] == counts
    assert [r.text or "" for r in got] == want
    assert [r.text is None for r in got] == [t is None for t in texts]


def test_repeats_edges(spark):
    assert sentence_spans.without_repeats(table(spark, [])).count() == 0
    long = " ".join(f"w{i}." for i in range(40))
    rows = sentence_spans.without_repeats(table(spark, [(1, long), (1, long), (2, long), (None, long)])).collect()
    assert sorted((r.doc_id or 9, r.n_removed) for r in rows) == [(1, 0), (1, 0), (2, 40), (9, 40)]


def test_a_forced_collision_removes_nothing(spark, monkeypatch):
    """Runs that agree in the first 64 bits, but not in the check, are different runs."""
    real = sentence_spans.sentence_runs

    def collide(data, off, shifted=False):
        runs = real(data, off, shifted)
        return runs._replace(hashes=np.full_like(runs.hashes, 12345))

    rng = random.Random(8)
    texts = pa.array([prose(rng, 120) for _ in range(6)])
    monkeypatch.setattr(sentence_spans, "sentence_runs", collide)
    batch = pa.RecordBatch.from_arrays([pa.array(range(6), pa.int64()), pa.array(range(10, 16), pa.int64()), texts], ["i", "k", "t"])
    rows = [r for b in sentence_spans._postings([batch], 0, 1, False) for r in b.to_pylist()]
    assert all(r["fragment"] == 0 for r in rows)  # nothing is settled in the task
    assert sentence_spans._replies(pa.Table.from_pylist(rows, sentence_spans._OUT)).num_rows == 0
    batch = pa.RecordBatch.from_arrays([pa.array(range(12), pa.int64()), pa.array(range(10, 22), pa.int64()), pa.array(texts.to_pylist() * 2)], ["i", "k", "t"])
    rows = [r for b in sentence_spans._postings([batch], 0, 1, False) for r in b.to_pylist()]
    found = sentence_spans._replies(pa.Table.from_pylist(rows, sentence_spans._OUT)).to_pylist()
    assert {r["key"] for r in found if r["later"]} == set(range(16, 22))


def test_scripts_without_spaces(spark):
    rng = random.Random(9)
    clause = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(n))
    passage = "".join(clause(12) + "。" for _ in range(6))
    thai = "".join(chr(rng.randrange(0x0E01, 0x0E2F)) for _ in range(60))
    texts = [clause(30) + "！" + passage + clause(20) + "？", clause(40) + "。" + passage + clause(15) + "。", clause(90), thai + " " + clause(5), clause(7) + " " + thai]
    for shifted in (False, True):
        got = [r.text for r in sentence_spans.without_repeats(table(spark, texts), shifted=shifted).orderBy("doc_id").collect()]
        assert got[0] == texts[0] and got[2] == texts[2] and got[3] == texts[3]
        assert len(got[1]) <= len(texts[1]) - (len(passage) - 26)
        assert not shifted or len(got[4]) <= len(texts[4]) - (60 - 32)


def windows(text, size):
    w = text.lower().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


@pytest.mark.parametrize("size", [2_000_000, 300])
def test_no_window_stays_wherever_it_stands(spark, size, monkeypatch):
    monkeypatch.setattr(sentence_spans, "FRAGMENT_RUNS", size)
    monkeypatch.setattr(sentence_spans, "TASK_RUNS", size)
    rng = random.Random(6)
    passages = [prose(rng, 50, stops=False), prose(rng, 90), " ".join(["same"] * 60), " ".join(WORDS[:7] * 9)]
    texts, inside = [prose(rng, 200, stops=k % 2 > 0) for k in range(20)], {}
    for p in passages:  # at every distance from the sentence's start, in other lines, after an edit
        for before in range(18):
            inside[len(texts)] = p
            texts.append(" ".join([prose(rng, 30), *prose(rng, before, stops=False).split(), p.replace(" ", "\n", before), prose(rng, 25, stops=False)]))
    w = texts[0].split()
    texts.append(" ".join([*w[:60], "inserted", *w[60:]]))
    got = sentence_spans.without_repeats(table(spark, texts), shifted=True).orderBy("doc_id").collect()
    seen = set()
    for k, (r, t) in enumerate(zip(got, texts, strict=True)):
        assert not windows(r.text, 50) & seen
        if k < 20:
            assert r.text == t and r.n_removed == 0
        elif k in inside and windows(t, 50) & seen:
            own, kept, p = t.split(), r.text.split(), inside[k].split()
            start = next(i for i in range(len(own)) if own[i : i + len(p)] == p)
            assert kept[:start] == own[:start] and kept[len(kept) - 25 :] == own[-25:]  # nothing around it goes
            assert len(own) - len(kept) >= len(p) - 2 * sentence_spans.PIECE_WORDS
        seen |= windows(t, 50)
    assert got[-1].n_removed > 0 and len(got[-1].text.split()) <= 1 + 50


def test_op6_finds_a_passage_at_another_distance(spark, tmp_path):
    rng = random.Random(7)
    p = prose(rng, 60, stops=False)
    table(spark, [p + " end", prose(rng, 5, stops=False) + " " + p]).write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.n_removed > 0 for r in registry.op6_substring_dedup(spark, str(tmp_path)).orderBy("doc_id").collect()] == [False, True]


# 8: byte BPE

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_bpe_is_tiktoken(spark, corpus):
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = [*corpus, "don't I'll 's 're", "<|endoftext|> <unk>", "日本語 ▁▁　x", "a" * 2000, "\x00\x01 \n\n\t x  "] + ["".join(rng.choice("ab é\n ▁1!'st") for _ in range(60)) for _ in range(60)]
    df = table(spark, texts)
    got = byte_bpe.round_trip(df, PATH, public_tokenizers.PATTERN).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        ids = enc.encode_ordinary(t or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    back = byte_bpe.with_bytes(byte_bpe.with_ids(df, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN).orderBy("doc_id").collect()
    assert [bytes(r.decoded).decode() for r in back] == [t or "" for t in texts]
    assert byte_bpe.round_trip(table(spark, []), PATH, public_tokenizers.PATTERN).count() == 0


def test_bpe_forgets_without_changing_ids(monkeypatch, corpus):
    texts = [t or "" for t in corpus]
    bpe = byte_bpe.ByteBPE(byte_bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    whole = bpe.encode_all(texts)[0].tolist()
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 10)
    assert sum([bpe.encode_all([t])[0].tolist() for t in texts], []) == whole
    other = byte_bpe.ByteBPE(byte_bpe.read_ranks(PATH), public_tokenizers.PATTERN + "|(?!)")  # by the expression itself
    assert other.encode_all(texts)[0].tolist() == whole


# 3: toxicity


def test_toxicity_held_out(spark):
    rng = random.Random(8)
    texts = [prose(rng, 60) + (" you vile " + prose(rng, 5) if i % 5 == 0 else "") for i in range(1500)]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, 1 if i % 5 == 0 else 0) for i in range(0, 1500, 2)] + [(3, None), (5000, 1)], "doc_id long, toxic int")
    got = toxicity.with_toxicity(docs, labels).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    unseen = [r for r in got if r.held_out or r.doc_id % 2]
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in unseen) / len(unseen) > 0.97
    again = {r.doc_id: r.score for r in toxicity.with_toxicity(docs.repartition(3), labels.repartition(2)).collect()}
    assert again == {r.doc_id: r.score for r in got}


def test_ftrl_is_the_naive_one():
    """The update rule written out, one coordinate at a time."""
    rng = random.Random(3)
    rows = [np.array(sorted(rng.sample(range(40), 8))) for _ in range(60)]
    labels = np.array([float(3 in r or 7 in r) for r in rows])
    s = toxicity.Settings(l1=0.3, epochs=2)
    z, n = Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= s.l1:
            return 0.0
        return -(z[i] - (s.l1 if z[i] > 0 else -s.l1)) / ((s.beta + n[i] ** 0.5) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for x, y in zip(rows, labels, strict=True):
            w = {int(i): weight(int(i)) for i in x}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for i in w:
                sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / s.alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    got = toxicity.fit_ftrl(rows, labels, s)
    assert np.allclose(got[:40], [weight(i) for i in range(40)]) and not got[40:].any()


def test_beginnings_of_words():
    texts = pa.array(["Abcde abcdx abc", "", "ÀÀab ÀÀac abcde"])
    (_, _, data, off), = words.chunks(texts)
    w = words.words(data, off, words.ALNUM)
    (h, of), (h5, of5) = words.beginnings(data, w, words.ALNUM, (4, 5))
    assert of.tolist() == [0, 1, 3, 4, 5] and h[0] == h[1] == h[4] != h[2] and h[2] == h[3]
    assert of5.tolist() == [0, 1, 3, 4, 5] and h5[0] == h5[4] != h5[1]


def test_toxicity_sample_is_bounded(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, 30) + (" vile words here" if i % 2 else "")) for i in range(80)]
    labelled = spark.createDataFrame([(i, t, i % 2) for i, t in rows], "doc_id long, text string, label int")
    sizes = {i: len(next(toxicity.text_features(pa.array([t])))) for i, t in rows}
    order = [r.doc_id for r in labelled.orderBy(F.xxhash64("doc_id")).collect()]
    whole = toxicity.fit(labelled)
    few = toxicity.fit(labelled, max_coordinates=sum(sizes[i] for i in order[:20]))
    want = toxicity.fit_ftrl([next(toxicity.text_features(pa.array([dict(rows)[i]]))) for i in order[:20]], np.array([float(i % 2) for i in order[:20]]))
    assert dict(zip(*few, strict=True)) == {k: want[k] for k in np.flatnonzero(want)} != dict(zip(*whole, strict=True))
    assert toxicity.fit(labelled, max_coordinates=1) is not None and toxicity.fit(labelled.limit(0)) is None


def test_toxicity_edges(spark):
    assert toxicity.with_toxicity(table(spark, []), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.with_toxicity(table(spark, ["a", None, ""]), none).collect()] == [0.0] * 3
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    rows = toxicity.with_toxicity(table(spark, [(1, "a b"), (2, ""), (2, None), (None, "x")]).withColumn("score", F.lit("clash")), labels).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)


# 9: sharding


def brute_capacity(sizes, shards):
    low, high = max([0, *sizes]), sum(sizes)
    while low < high:
        middle, used, filled = (low + high) // 2, 1, 0
        for s in sizes:
            used, filled = (used + 1, s) if filled + s > middle else (used, filled + s)
        low, high = (low, middle) if used <= shards else (middle + 1, high)
    return low


@pytest.mark.parametrize("shards", [1, 4, 16])
def test_shards_are_minimax(spark, corpus, shards):
    texts = corpus + [corpus[0]] * 30
    rows = sharding.shard_documents(table(spark, texts).withColumn("shard", F.lit("clash")), shards).collect()
    sizes, groups, of = defaultdict(int), defaultdict(int), defaultdict(set)
    for r in rows:
        t = r.text or ""
        assert r.size == len(t.encode()) + 1 and r.law == "bytes" and r.grown_shard is None
        sizes[r.shard] += r.size
        groups[hashlib.md5(t.encode()).hexdigest()] += r.size
        of[t].add(r.shard)
    assert max(sizes.values()) == brute_capacity([groups[h] for h in sorted(groups)], shards)
    assert all(len(s) == 1 for s in of.values()) and set(sizes) <= set(range(shards))
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_shards_of_odd_rows(spark):
    rows = sharding.shard_documents(table(spark, [(None, "a"), (None, "a"), (3, None), (3, ""), (3, "b"), (3, "b")]).withColumn("__h", F.lit("own")).withColumn("_shard", F.lit(1)), 2).collect()
    assert len(rows) == 6 and all(r["__h"] == "own" and r._shard == 1 for r in rows)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_shards_of_nothing(spark):
    assert sharding.shard_documents(table(spark, [])).count() == 0


# 10: fingerprints


def brute_paragraphs(text):
    """The paragraphs of a text, long ones in pieces of PARAGRAPH_WORDS words, with how often each occurs."""
    out = Counter()
    for line in re.split(rb"[\r\n]", text.encode()):
        w = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", line)]
        for k in range(0, len(w), fingerprints.PARAGRAPH_WORDS):
            some = w[k : k + fingerprints.PARAGRAPH_WORDS]
            out[line[some[0][0] : some[-1][1]]] += 1
    return out


def brute_likeness(a, b):
    a, b = brute_paragraphs(a), brute_paragraphs(b)
    return 2 * (a & b).total() / (a.total() + b.total()) if a or b else 1.0


@pytest.mark.parametrize("bucket_bytes", [400, 9000, 1 << 30])  # more ranges than rows in the first
def test_versions(spark, corpus, bucket_bytes):
    texts = [t for t in corpus]
    docs = table(spark, texts).withColumn("part", F.lit(1)).withColumn("kind", F.lit(2)).withColumn("h", F.lit(3))
    rows = fingerprints.version_fingerprints(docs, bucket_bytes=bucket_bytes).orderBy(F.desc("doc_id")).collect()
    assert len(rows) == len(texts)
    plain = [t or "" for t in reversed(texts)]
    for k, r in enumerate(rows):
        t, after = plain[k], plain[(k + 1) % len(plain)]
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.near_edited, r.near_next) == (brute_likeness(t, edited), brute_likeness(t, after))
        cells = [bytes.fromhex(r.fingerprint)[k : k + 14] for k in range(0, 14 * fingerprints.CELLS, 14)]
        assert sum(int.from_bytes(c[:2]) for c in cells) == 3 * brute_paragraphs(t).total()
    by_text = defaultdict(set)
    for t, r in zip(plain, rows, strict=True):
        by_text[t].add(r.fingerprint)
    assert all(len(f) == 1 for f in by_text.values())
    long = [r for t, r in zip(plain, rows, strict=True) if len(t) > 600 and 0 < r.doc_id < 60]  # the next is no copy
    assert sum(r.near_edited > r.near_next for r in long) > 0.9 * len(long)
    assert fingerprints.version_fingerprints(table(spark, [])).count() == 0
    one = fingerprints.version_fingerprints(table(spark, ["abc. def."])).first()
    assert one.near_next == 1.0
    rows = fingerprints.version_fingerprints(table(spark, [(None, "a"), (5, "b"), (5, "b"), (5, "c"), (None, None)]), bucket_bytes=1).collect()
    assert sorted((r.doc_id is None, r.n_chars) for r in rows) == [(False, 1)] * 3 + [(True, 0), (True, 1)]
    with_own = fingerprints.fingerprints(table(spark, ["x\ny", None, "x\ny"]).withColumn("fingerprint", F.lit(0))).collect()
    assert with_own[0].fingerprint == with_own[2].fingerprint != with_own[1].fingerprint == "0" * 28 * fingerprints.CELLS


def test_peeling_recovers_the_differences():
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 2**63, 900, dtype=np.uint64)
    a, b = keys[:600], keys[300:]
    make = lambda k: fingerprints.Digests(k, np.zeros(len(k), np.int64), np.array([len(k)]))
    assert [x.tolist() for x in fingerprints.differences(make(a), make(b))] == [[300], [300]]
    done, _, k, side = fingerprints.peel(fingerprints.subtract(fingerprints.build(a, np.zeros(600, np.int64), 1, 3072), fingerprints.build(b, np.zeros(600, np.int64), 1, 3072)))
    assert done.all() and set(k[side > 0].tolist()) == set(keys[:300].tolist()) and set(k[side < 0].tolist()) == set(keys[600:].tolist())


# 7: HTML


def test_main_text(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site <nav><a href="/">Home</a></nav></header>
    <div class="cookie-notice">We use cookies</div><main><article><header><h1>Title &amp; more</h1></header><p>One <b>two</b>\n three&nbsp;x</p><div class="ad">Buy</div>
    <p>Four<br>five<ul><li>a<li>b</ul><section id="comments"><p>no</p></section><form><p>sub</p></form><aside>side</aside><p hidden>gone</p></article></main><footer>&copy;</footer></body></html>"""
    assert html_text.page_text(page) == "Title & more\nOne two three x\nFour\nfive\na\nb"
    assert html_text.page_text("plain &lt;text&gt; <p>a") == "plain <text>\na"
    assert html_text.page_text("<article><p>cut <a href='x") == "cut"
    assert html_text.page_text("") == "" and html_text.page_text("<nav>x</nav>") == ""
    # No article is marked: the site's repeated parts go by the style tree.
    rng = random.Random(1)
    pages = [(i, f"http://a.example/{i}", f"<body><div class='top'><span>Welcome to us</span></div><div class='text'><p>{prose(rng, 30)}</p></div><div class='end'><p>All the best</p></div></body>") for i in range(30)]
    df = spark.createDataFrame([*pages, (50, None, None), (51, "nohost", "<p>x</p>"), (52, "http://b.example/", pages[0][2])], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r.text for r in html_text.main_text(df).collect()}
    for i, _, h in pages:
        assert got[i] == " ".join(re.search("<p>(.*?)</p>", h)[1].split())
    assert got[50] == "" and got[51] == "x" and got[52].startswith("Welcome to us\n")
    assert html_text.main_text(df.limit(0)).count() == 0


def test_class_names_inside_an_article_need_the_tree(spark):
    names = ["share-price", "search-results", "notice", "related-work", "banner-image", "sponsor"]
    rng = random.Random(12)
    inside = lambda n: f"<div class='{n}'>{prose(rng, 9)}</div>"
    page = "<article><p>a</p>" + "".join(inside(n) for n in names) + "<div class='ad'>buy</div><ul class='comment-list'><li>x</li></ul><h2 id='comments'>h</h2><math><mi>y</mi></math></article>"
    text = html_text.page_text(page)
    assert len(text.split("\n")) == 9 and "buy" not in text and "x" not in text.split("\n") and text.endswith("h\ny")
    assert html_text.page_text("<div class='share-buttons'>s</div><div class='share-price'>9</div><div class='notice'>n</div><p>a</p>") == "9\na"
    rows = [(i, f"http://a.example/{i}", f"<article><p>{prose(rng, 20)}</p><div class='notice'>seen by {i % 4}</div><div class='share-price'>at {i}</div></article>") for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_tree", F.lit(1)).withColumn("__host", F.lit("own"))
    got = html_text.main_text(df)
    assert {"_tree", "__host"} <= set(got.columns)
    for r in got.collect():  # the notice is repeated unevenly, the other branch isn't repeated
        assert r["__host"] == "own" and "seen by" not in r.text and f"at {r.page_id}" in r.text


def brute_tree(pages):
    """Importance of every path of one host's pages, none a copy of another, by the formulas."""
    looks, features, having = defaultdict(Counter), defaultdict(Counter), Counter()
    for html in pages:
        blocks, elements = html_text.parse(html)
        for path, children in {(e.path, tuple(e.children)) for e in elements}:
            looks[path][children] += 1
        for path, value in {(p, b.text) for b in blocks for p in b.paths}:
            features[path][value] += 1
        having.update({e.path for e in elements})
    out = {}
    for path, m in having.items():
        if m == 1:
            out[path] = (1, 1.0)
            continue
        total = looks[path].total()
        entropy = -sum(n / total * np.log(n / total) for n in looks[path].values())
        even = np.mean([np.log(n) for n in features[path].values()]) if features[path] else np.log(m)
        out[path] = (m, (0.1 * entropy + 0.9 * (np.log(m) - even)) / np.log(m))
    return out


def test_importance_is_brute_force(spark):
    rng = random.Random(13)
    pages = [f"<body><div class='x'>{rng.choice(WORDS[:4])}</div><ul>{'<li>same</li>' * rng.randrange(1, 4)}</ul><div id='t'><p>{prose(rng, 12)}</p>{'<b>z</b>' * (i % 3)}</div></body>" for i in range(25)]
    df = spark.createDataFrame([("h", p) for p in pages] + [("one", pages[0]), (None, pages[1])], "host string, html string")
    got = {(r.host, r.path): (r.n_pages, r.importance) for r in html_text.style_tree(df).collect()}
    for host, some in (("h", pages), ("one", pages[:1])):
        want = brute_tree(some)
        assert {p for h, p in got if h == host} == set(want)
        for path, (n, importance) in want.items():
            assert got[host, path][0] == n and got[host, path][1] == pytest.approx(importance)


def planted_pages(rng, hosts=6, pages=25):
    """Pages whose furniture no tag or class name gives away: (page_id, url, html), main text and planted furniture."""
    rows = []
    for h in range(hosts):
        fixed = {k: prose(rng, 8) for k in "abcd"}
        for i in range(pages):
            body = [prose(rng, rng.randrange(8, 30)) for _ in range(rng.randrange(2, 5))]
            main = "".join(f"<p>{p}</p>" for p in body)
            top, end = f"<div class='c1'><a href='/'>{fixed['a']}</a> <span>{fixed['b']}</span></div>", f"<div class='c9'>{fixed['c']} {h}</div>"
            inside = f"<div class='c5'>{fixed['d']}</div>"
            page = f"<html><body>{top}<div class='c2'>{main}{inside}</div>{end}</body></html>" if h % 2 else f"<html><body>{top}<article>{main}{inside}</article>{end}</body></html>"
            rows.append(((len(rows), f"https://h{h}.example/{i}", page), [" ".join(p.split()) for p in body], [" ".join(x.split()) for x in fixed.values()]))
    return rows


def test_the_tree_finds_unmarked_furniture(spark):
    """With the tree against without: furniture that only repetition shows."""
    rows = planted_pages(random.Random(14))
    df = spark.createDataFrame([r for r, _, _ in rows], "page_id long, url string, html string")
    texts = {r.page_id: r.text for r in html_text.main_text(df).collect()}
    kept = cut = left = plain_left = changed = 0
    for (i, _, page), body, furniture in rows:
        alone = html_text.page_text(page)
        kept += sum(p in texts[i].split("\n") for p in body)
        cut += len(body)
        left += sum(f in texts[i] for f in furniture)
        plain_left += sum(f in alone for f in furniture)
        changed += alone != texts[i]
    assert kept == cut and left == 0 and plain_left >= 2 * len(rows) and changed == len(rows)


def test_deep_pages_and_many_children():
    deep = "<div>" * 700
    page = f"<article><p>first</p>{deep}<nav>menu</nav><p hidden>gone</p><p>inner</p>{'</div>' * 700}<p>last</p></article><p>outside</p>"
    assert html_text.page_text(page) == "first\ninner\nlast"
    assert html_text.page_text(f"<body>{deep}<article><p>a</p></article>{'</div>' * 700}<p>b</p></body>") == "a"
    looks = []
    for tail in ("<b>x</b>", "<i>x</i>"):
        batch = pa.RecordBatch.from_arrays([pa.array(["h"]), pa.array(["<ul>" + "<li>y</li>" * 100 + tail + "</ul>"]), pa.array([1.0])], ["host", "html", "weight"])
        rows = [r for b in html_text._features(iter([batch])) for r in b.to_pylist()]
        looks.append({r["value"] for r in rows if r["path"] == "/ul" and r["kind"] == 0})
    assert looks[0] != looks[1]


def test_copies_are_no_boilerplate(spark):
    rng = random.Random(3)
    table_, cell = prose(rng, 12), prose(rng, 12)
    article = f"<article><p>{prose(rng, 30)}</p><div class='data'>{table_}</div><table><tr><td>{cell}</td></tr></table></article>"
    rows = [(i, f"http://a.example/p?print={i}", f"<body><div class='v{i % 2}'>v</div>{article}</body>") for i in range(10)]
    rows += [(10 + i, "http://b.example/x", f"<body>{article}</body>") for i in range(10)]  # the same row again and again
    # different pages still have their furniture cut
    rows += [(20 + i, f"http://c.example/{i}", f"<body><div class='top'>Welcome</div><div class='text'>{prose(rng, 30)}</div></body>") for i in range(10)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(20):
        assert table_ in got[i] and cell in got[i]
    assert not any("Welcome" in got[i] for i in range(20, 30))


# 8: further rows of byte-level BPE


def test_round_trip_of_odd_rows(spark):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    long = "long words " * 30_000 + "x" * 50_000
    rows = [(1, "same"), (1, "same"), (None, None), (2, ""), (3, long), (4, "\x00 \u2028 \U0001f600")]
    df = table(spark, rows).withColumn("n_tokens", F.lit("clash")).withColumn("_coded", F.lit("own")).withColumn("__coded", F.lit(5))
    got = byte_bpe.round_trip(df, path, pattern).collect()
    assert len(got) == len(rows) and all(r._coded == "own" and r["__coded"] == 5 for r in got)
    for r in got:
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        assert (r.n_tokens == 0) == (not r.text)
    assert len({r.ids_sha256 for r in got if r.doc_id == 1}) == 1
    assert byte_bpe.round_trip(df.limit(0), path, pattern).count() == 0


# 2: chat


def test_perspectives(spark):
    turns = [(1, 0, "system", "Be kind."), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 3, None, "who"), (None, 0, "x", "y"), (3, 0, "system", "only")]
    r = chat.rotate_perspectives(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("head", F.lit(1)))
    got = {(d.conv_id, d.perspective): d for d in chat.dialogues(r).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "x")}
    d = got[1, "ann"]
    assert d.text == "<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>assistant\nhi < |im_end|><|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n<|im_start|>user name=unknown\nwho<|im_end|>\n"
    assert [d.text[m.start : m.end] for m in d.masks] == ["hi < |im_end|><|im_end|>"]
    assert chat.rotate_perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_perspectives_are_brute_force(spark, monkeypatch):
    """Repeated turns, turns without number, ties, null dialogues, narrators and long dialogues, turn by turn."""
    monkeypatch.setattr(chat, "BLOCK", 4)
    rng = random.Random(15)
    turns = [(rng.choice([1, 2, 3, None]), rng.choice([None, *range(15)]), rng.choice(["ann", "bob", "system", None, "c\nd"]), rng.choice([None, "", "x", prose(rng, 3), "<|"])) for _ in range(160)]
    turns += turns[:9] + [(4, 0, "system", "only")]
    got = {}
    for r in chat.rotate_perspectives(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("nth", F.lit(1)).withColumn("block", F.lit("b"))).collect():
        got.setdefault((r.conv_id, r.perspective), []).append((r.start, r.end, r.turn, r.role, r.name, r.rendered, r.mask_start, r.mask_end))
    name = lambda s: re.sub("[\r\n]+", " ", "unknown" if s is None else s).replace("<|", "< |")
    want = {}
    for c in {t[0] for t in turns}:
        some = sorted(((n is None, n or 0, name(s), (x or "").replace("<|", "< |")) for k, n, s, x in turns if k == c))
        for p in {s for _, _, s, _ in some} - {"system"}:
            at, rows = 0, []
            for none, n, s, x in some:
                head = "<|im_start|>" + ("assistant" if s == p else s if s == "system" else f"user name={s}") + "\n"
                rendered = head + x + "<|im_end|>\n"
                end = at + len(rendered)
                mask = (at + len(head), end - 1) if s == p else (end, end)
                rows.append((at, end, None if none else n, "assistant" if s == p else s if s == "system" else "user", None if s in (p, "system") else s, rendered, *mask))
                at = end
            want[c, p] = rows
    assert {k: sorted(v, key=lambda r: r[0]) for k, v in got.items()} == want


def test_perspectives_of_many_turns(spark):
    turns = [(1, i, "ab"[i % 2], f"t{i}") for i in range(3000)]
    rows = sorted(chat.rotate_perspectives(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).where("perspective = 'a'").collect(), key=lambda r: r.turn)
    at = 0
    for r in rows:
        assert r.start == at
        at = r.end


# 1: training order


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutation(n):
    slots = training_order.permute(np.arange(n), n, 42)
    assert sorted(slots.tolist()) == list(range(n))
    assert training_order.permute(slots, n, 42, inverse=True).tolist() == list(range(n))
    assert n < 100 or (training_order.permute(np.arange(n), n, 43) != slots).mean() > 0.9


def test_shards_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(training_order, "BLOCK", 4)
    monkeypatch.setattr(training_order, "BUCKET_BYTES", 20_000)
    rng = random.Random(6)
    docs = [(i, [rng.randrange(50_000) for _ in range(rng.choice([0, 3, 15, 16, 17, 60, 300]))]) for i in range(200)] + [(None, [1, 2]), (7, None), (7, None)]
    df = spark.createDataFrame(docs, "doc_id long, ids array<int>").withColumn("slot", F.lit("clash")).coalesce(2)
    folder = f"file://{tmp_path}/out"
    m = sorted(training_order.materialise(df, folder, length=16, end=50256, pad=50257, key=9, per_shard=64).collect(), key=lambda r: r.sequence)
    assert sorted(r.slot for r in m) == [r.sequence for r in m] == list(range(len(m)))
    records = training_order.read_slots(folder, 0, 10**9)
    assert len(records) == len(m) and (training_order.read_slots(folder, 70, 5) == records[70:75]).all()
    assert all((r.shard, r.record) == divmod(r.slot, 64) for r in m)
    assert 1 < sum(r.n_tokens < 16 for r in m) <= 1 + sum(4 * len(x or []) for _, x in docs) // 20_000  # one padded sequence for each bucket
    assert all((records[r.slot][r.n_tokens :] == 50257).all() for r in m)
    stream = [t for r in m for t in records[r.slot][: r.n_tokens].tolist()]
    got = "/".join(map(str, stream)).split("/50256")
    assert sorted(x.strip("/") for x in got) == sorted([*("/".join(map(str, x or [])) for _, x in docs), ""])
    inside, holders = iter([r.doc_ids for r in m]), defaultdict(int)
    for ids in inside:
        assert len(ids) >= 1
        for i in ids:
            holders[i] += 1
    assert set(holders) == {i for i, _ in docs}
    other = f"file://{tmp_path}/other"  # the same documents otherwise partitioned
    again = sorted(training_order.materialise(df.repartition(7, "ids"), other, length=16, end=50256, pad=50257, key=9, per_shard=64).collect(), key=lambda r: r.sequence)
    assert [r.asDict() for r in again] == [r.asDict() for r in m]
    assert (training_order.read_slots(other, 0, 10**9) == records).all()
    texts = table(spark, [(i, "/".join(map(str, x or []))) for i, x in docs])
    encode = lambda t: training_order.listed(pa.array([[int(v) for v in (x or "").split("/") if v] for x in t.to_pylist()], pa.list_(pa.int64())))
    of_texts = training_order.materialise(texts, f"file://{tmp_path}/texts", length=16, end=50256, pad=50257, key=9, per_shard=64, ids_column="text", encode=encode)
    assert of_texts.agg(F.sum("n_tokens")).first()[0] == len(stream)
    digests = {r.slot: r.record_sha256 for r in training_order.record_digests(spark, folder, 16, "<u2", 64).collect()}
    assert digests == {k: hashlib.sha256(r.tobytes()).hexdigest() for k, r in enumerate(records)}
    assert training_order.materialise(df.limit(0), f"file://{tmp_path}/none", 16, 0, 0).count() == 0


# the pipeline


def test_pipeline_stages(spark, corpus, tmp_path):
    items = [x for x in items_of(corpus) if x[0] not in (2, 3)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(len(corpus))], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    table(spark, corpus).write.parquet(f"{tmp_path}/documents.parquet")
    docs, sf_dir = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)
    scores = {r.doc_id: r.score for r in toxicity.with_toxicity(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
    left = {i: t for i, t in enumerate(corpus) if scores[i] < 0.5}
    ids = sorted(left)
    groups = brute_groups([left[i] for i in ids])
    left = {i: left[i] for k, i in enumerate(ids) if groups[k][1] == k}
    ids = sorted(left)
    texts, _ = brute_without_repeats([left[i] for i in ids], shifted=True)
    found = brute_contamination(texts, items)
    want = {i: t for i, t, f in zip(ids, texts, found, strict=True) if not f[3]}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) == set(want)
    for k, i in enumerate(ids):
        if i in want and not found[k][1]:
            assert got[i].decoded_sha256 == hashlib.sha256(want[i].encode()).hexdigest()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "substring_dedup", "decontamination", "byte_bpe"]


def test_near_duplicates_loses_no_document(spark):
    a, b, c = "one two three four five six seven", "eight nine ten eleven twelve thirteen", "all of these words are its own alone"
    rows = [(7, a), (7, b), (7, a), (None, a), (None, c), (None, c), (3, b), (9, None), (9, None), (8, ""), (8, "")]
    docs = table(spark, rows).withColumn("row_id", F.lit(1)).withColumn("node", F.lit(2))
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(7, a), (3, b), (None, c), (9, None), (8, "")], key=str)


def test_pipeline_stages_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(None, None), (None, "a b"), (4, "x y z"), (4, "x y z"), (5, "")]
    for docs, least in ((table(spark, []), 0), (table(spark, rows), 4)):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs.withColumn("extra", F.lit(1)).withColumn("score", F.lit("s")), str(tmp_path))
            assert docs.count() == (least if name not in ("toxicity",) or not least else 5)
            if name != "byte_bpe":
                assert docs.columns == list(corpus_pipeline.COLUMNS)
