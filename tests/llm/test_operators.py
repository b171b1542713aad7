"""The training-data operators against plain versions, on small tables with hard rows."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vigil.llm import exact_dedup, importance, jaccard, language, lm, mixing, packing, quality_rules, secrets, urls

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, slot string, `a.b` int"
SF = "/root/testdata/sf0.001"
BASE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree at dusk " * 2
RARE = " ".join(f"w{i}" for i in range(60))
TEXTS = [None, "", " ", "one", "ONE", "a  b\tc", "a b c", "a b\x0bc", "a b c", BASE, BASE.upper(), RARE, RARE + " end",
         RARE.replace("w30", "x"), "x" * 3000, "w " * 4000, "é ü 漢字 \U0001f600 done", "a\x00b c", "same words here ok",
         "same words here ok", " ".join(f"v{i}" for i in range(3000)), "line\nline\nline\nother", "!!! 123"]


def rows():
    out = [(i, t, ("en", "de", None)[i % 3], ("s", None)[i % 2], 1, "x", i) for i, t in enumerate(TEXTS)]
    return out + [(3, "one", "en", "s", 1, "x", 0), (None, "one", None, None, None, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, empty):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for r in rows():
        groups[norm(r[1])].append(r[0])
    got = exact_dedup.exact_dedup(docs, fan_in=2).collect()
    assert len(got) == len(rows())
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_sha[r.text_sha256]
        real = [i for i in ids if i is not None]
        assert r.group_size == len(ids) and r.keep_id == (min(real) if real else None)
    for sha, ids in by_sha.items():
        assert sum(r.kept for r in got if r.text_sha256 == sha) == 1, ids
    assert exact_dedup.drop_copies(docs).count() == len(groups)
    assert exact_dedup.drop_copies(docs).columns == docs.columns
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_language(spark, docs, empty):
    train = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate(
        [("the house and the garden with the old tree", "en"), ("das haus und der garten mit dem alten baum", "de")] * 3)],
        "doc_id bigint, text string, lang string")
    learned = language.learn_dictionaries(train)
    got = {r.doc_id: r for r in language.predict_language(spark.createDataFrame(
        [(1, "the old garden and the tree"), (2, "der alte garten und das haus"), (3, "123 !"), (4, None)],
        "doc_id bigint, text string"), learned).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["en", "de", "und", "und"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.predict_language(docs, learned).count() == docs.count()
    assert language.learn_dictionaries(empty) == {} and language.predict_language(docs, {}).count() == docs.count()


def test_language_held_out(spark):
    import __spark_entry__ as entry
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = entry.queries()["op2_language"](spark, SF).where("held_out").join(truth, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.9 * len(got)


def test_lm_score(spark, docs, empty):
    train = docs.where("doc_id % 2 = 0")
    model, counts = lm.train(train, head=5, units=3, buckets=4, classes=3)
    got = sorted((tuple(r) for r in lm.score(docs, model, counts).collect()), key=repr)
    words = lambda t: (t or "").encode().lower().split()
    c = Counter()
    learn = [r for r in rows() if r[0] is not None and r[0] % 2 == 0]
    for r in learn:
        c.update(words(r[1]))
    n, v = sum(c.values()) + len(learn), len(c) + 1
    assert (model.tokens, model.words) == (n, v)
    want = []
    for r in rows():
        w = words(r[1])
        base = sum(np.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w) + np.log10((len(learn) + 0.1) / (n + 0.1 * (v + 1)))
        want.append((r[0], len(w) + 1, sum(c[x] > 0 for x in w) + 1, round(base, 6)))
    assert sorted(((g[0], g[1], g[2], round(g[3], 6)) for g in got), key=repr) == sorted(want, key=repr)
    assert all(g[4] < 0.5 for g in got)
    nothing, none = lm.train(empty)
    assert lm.score(docs, nothing, none).count() == docs.count() and lm.score(empty, model, counts).count() == 0


def test_lm_classes_follow_contexts_beyond_units(spark):
    rng = np.random.default_rng(2)
    texts = [(i, " ".join(f"the n{min(rng.integers(0, 40, 2))}x a v{min(rng.integers(0, 40, 2))}x" for _ in range(30))) for i in range(20)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    for head in (20, 80):  # most of the rare words out of the head, and none
        model, table = lm.train(df, head=head, units=14, buckets=1, classes=5)
        of = {bytes(r.word): r["class"] for r in table.collect()}
        words = Counter(w for _, t in texts for w in t.encode().split())
        assert {bytes(r.word): r.n for r in table.collect()} == words
        assert len({of[w] for w in sorted(words, key=lambda w: (-words[w], w))[14:]}) > 1  # all in one bucket
        moves = np.zeros((6, 6))
        for _, t in texts:
            path = [5, *(of[w] for w in t.encode().split()), 5]
            np.add.at(moves, (path[:-1], path[1:]), 1)
        share = (moves.sum(axis=0) + 0.1) / (moves.sum() + 0.6)
        assert np.allclose(model.moves, np.log10((moves + 5 * share) / (moves.sum(axis=1, keepdims=True) + 5)))
        size = Counter([5, *of.values()])
        emits = np.log10(moves.sum(axis=0) + 0.1 * (np.array([size[c] for c in range(6)]) + 1))
        got = {r.doc_id: r.score for r in lm.score(df, model, table).collect()}
        for i, t in texts:
            w = t.encode().split()
            path = [5, *(of[x] for x in w), 5]
            want = sum(np.log10(words[x] + 0.1) for x in w) + np.log10(20.1) + model.moves[path[:-1], path[1:]].sum() - emits[path[1:]].sum()
            assert abs(got[i] - want) < 1e-6


def test_lm_gains_are_those_of_a_move():
    rng = np.random.default_rng(4)
    rest = rng.integers(1, 40, (6, 6)).astype(float)
    before, after, old = {3: 2, 5: 1}, {3: 1, 4: 2}, 0  # of a word in class 0, by neighbour class

    def moved(c):
        t = rest.copy()
        for d, n in before.items():
            t[d, c] += n
        for d, n in after.items():
            t[c, d] += n
        return t
    worth = lambda t: lm.h(t).sum() - lm.h(t.sum(axis=1)).sum() - lm.h(t.sum(axis=0)).sum()
    got = lm.gains(np.zeros(4, dtype=np.int64), np.array([3, 5, 9, 10]), np.array([2.0, 1, 1, 2]), np.array([old]), moved(old))[0]
    assert np.allclose(got[:3] - got[old], [worth(moved(c)) - worth(moved(old)) for c in range(3)])


def test_lm_contexts_of_a_word_are_one_row(spark):
    df = spark.createDataFrame([("a x b",), ("b x a",), ("x z",)], "text string").coalesce(1)
    # classes: a 0, b 1, other words 2, border 3
    rows = lm.contexts(df, "text", [b"a", b"b"], np.array([0, 1, 2, 3]), 2).collect()
    got = [(bytes(r.word), dict(zip(r.codes, r.counts, strict=True))) for r in rows if r.word is not None]
    assert sorted(got) == [(b"x", {0: 1, 1: 1, 3: 1, 4 + 0: 1, 4 + 1: 1, 4 + 2: 1}), (b"z", {2: 1, 4 + 3: 1})]
    # not known: two words in turn, and the known side of each
    rows = lm.contexts(df, "text", [b"a", b"b"], np.array([0, 1, -1, 3]), 2).collect()
    assert [(bytes(r.word), bytes(r.after), r.counts) for r in rows if r.after is not None] == [(b"x", b"z", [1])]
    assert sorted((bytes(r.word), sorted(zip(r.codes, r.counts, strict=True))) for r in rows if r.word is not None and r.after is None) == [
        (b"x", [(0, 1), (1, 1), (3, 1), (4, 1), (5, 1)]), (b"z", [(7, 1)])]


def test_lm_large_counts_rise_as_small_ones_do():
    base, rng = np.arange(30.0).reshape(5, 6) * 50 + 40, np.random.default_rng(2)
    row, n, old = rng.integers(0, 5, 40), rng.integers(0, 30, 40).astype(float), rng.integers(0, 6, 40)
    less = base[row].copy()
    less[np.arange(40), old] -= n
    assert np.allclose(lm.grown(base, row, n, old), lm.h(less + n[:, None]) - lm.h(less))


def test_secrets_of_letters_and_beside_words():
    enc = secrets.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = np.random.default_rng(6)
    make = lambda signs, n: "".join(rng.choice(list(signs), n))
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    for text in [*(make(letters, n) for n in (24, 32, 40) for _ in range(50)), *(make(letters + "0123456789", 20) for _ in range(50)),
                 *("/services/notifications/incoming/" + make(letters + "0123456789", 24) for _ in range(50))]:
        assert secrets.random_spans(text, enc, []) == [(0, len(text), "random")], text
    for text in ("getUserAuthenticationTokenFactoryImpl", "com/example/service/HttpRequestHandlerAdapter", "a" * 30,
                 "donaudampfschifffahrtsgesellschaft", "0123456789" * 3, "some_long_name/with_many_parts-and-2024"):
        assert secrets.random_spans(text, enc, []) == [], text


def test_lm_units_and_classes_grow():
    assert lm.units_for(10**7) > lm.units_for(10**4) and lm.classes_for(10**7) > lm.classes_for(10**5)


def test_exchange_finds_classes():
    rng = np.random.default_rng(0)
    counts = np.zeros((9, 9))
    for a in range(8):
        for b in range(8):
            counts[a, b] = 50 if a % 2 == b % 2 else rng.integers(0, 2)
    of = lm.exchange(counts, 2)
    assert len({of[i] for i in range(0, 8, 2)}) == 1 and len({of[i] for i in range(1, 8, 2)}) == 1 and of[0] != of[1]


def test_secrets(spark, docs, empty):
    args = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    text = ('é token: a secret: abcdefghij API_KEY="Zx81kQ" passwd = hunter2hunter2 AKIAABCDEFGHIJKL12 AKIASHORT '
            + "0123456789abcdef" * 2 + " Xk29Qm7Lp0Zr84VtBn13Ws q1w2e3r4t5y6u7i8o9p0AbCd " + "D41D8CD98F00B204E9800998ECF8427E"
            + " internationalization_of_the_world_2024 123e4567-e89b-12d3-a456-426614174000")
    df = spark.createDataFrame([(1, text), (2, None), (3, "plain words only, nothing else here")], "doc_id bigint, text string")
    got = {r.doc_id: [(s.kind, text[s.start:s.end]) for s in r.found] for r in secrets.find_secrets(df, *args).collect()}
    assert got[2] == got[3] == []
    assert [s for s in got[1] if s[0] != "random"] == [
        ("assign", "secret: abcdefghij"), ("assign", "passwd = hunter2hunter2"), ("access", "AKIAABCDEFGHIJKL12"),
        ("hex", "0123456789abcdef" * 2)]
    assert {s[1] for s in got[1] if s[0] == "random"} == {"Xk29Qm7Lp0Zr84VtBn13Ws", "q1w2e3r4t5y6u7i8o9p0AbCd"}
    assert secrets.masked("ab token=12345678 c", [(3, 17, "assign")]) == "ab <assign> c"
    assert secrets.find_secrets(docs, *args).count() == docs.count() and secrets.find_secrets(empty, *args).count() == 0


def test_quality_rules(docs, empty):
    def plain(t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        c = Counter(grams)
        hit = {i + k for i, g in enumerate(grams) if c[g] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit),
                len(w) < 10 or 100 * len(hit) > 20 * len(w))

    got = [tuple(r)[:7] for r in quality_rules.quality_rules(docs).collect()]
    assert sorted(got, key=repr) == sorted(((r[0], *plain(r[1])) for r in rows()), key=repr)
    assert quality_rules.quality_rules(empty).count() == 0


def test_quality_rules_reject_random_text():
    import zstandard
    coder = zstandard.ZstdCompressor(level=quality_rules.LEVEL, write_content_size=False)
    rng = np.random.default_rng(8)
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"

    def noise(signs, size):
        return " ".join("".join(rng.choice(list(signs), rng.integers(6, 13))) for _ in range(size // 6))[:size].encode()
    for size in (300, 800, 3000, 6000, 16000, 40000):
        assert not quality_rules.verdict(noise(upper + lower + digits, size), coder)[0], size
    for size in (1500, 3000, 6000, 16000, 40000):
        assert not quality_rules.verdict(noise(lower + digits, size), coder)[0], size
    for size in (5000, 16000, 40000):
        assert not quality_rules.verdict(noise("0123456789abcdef", size), coder)[0], size
    import pyarrow.parquet as pq
    texts = [t.encode() for t in pq.read_table(f"{SF}/documents.parquet", columns=["text"]).column(0).to_pylist() if t]
    prose = max((t for t in texts if quality_rules.verdict(t, coder)[0] and not quality_rules.repeated_words(t.split())), key=len)[:4096]
    # the last, shorter chunk takes part, by its own length's limits
    assert quality_rules.verdict(prose + noise(upper + lower + digits, 3000), coder)[2] == 3000 / (len(prose) + 3000)


def test_packing(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    coder = packing.Coder(path, public_tokenizers.PATTERN)
    odd = ["a  b\n\n  c\t\td \n e", "x　　y z", " q", "<|endoftext|> 's's", "foo\x1c!bar \x85x", " \n", "12a3 don't"]
    for t in [r[1] or "" for r in rows()] + odd:
        assert np.frombuffer(coder.ids(t), "<u4").tolist() == [*own.encode(t, add_special_tokens=False).ids, 1]
    got = packing.pack(docs, path, public_tokenizers.PATTERN).collect()
    fills = defaultdict(list)
    for r in got:
        fills[r.sequence_id].append((r.offset, r.length))
    for own_ in fills.values():
        at = 0
        for offset, length in sorted(own_):
            assert offset == at and length > 0
            at += length
        assert at == 2048 or at & (at - 1) == 0
    want = Counter((r[0], len(coder.ids(r[1] or "")) // 4) for r in rows())
    have = Counter()
    for r in got:
        have[r.doc_id, r.doc_tokens] += r.length
    assert have == {k: k[1] * n for k, n in want.items()}
    assert packing.pack(empty, path, public_tokenizers.PATTERN).count() == 0


def test_importance(spark, docs, empty):
    good, bad = "alpha beta gamma delta", "spam junk spam junk"
    df = spark.createDataFrame([(i, (good if i % 2 else bad) * 5) for i in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    keys, _, least = importance.resample(df, labels)
    found = keys.collect()
    assert min(r.log_weight for r in found if r.doc_id % 2) > max(r.log_weight for r in found if r.doc_id % 2 == 0)
    for k in (1, 7, 40):
        assert importance.kth_largest(keys, k) == sorted((r.key for r in found), reverse=True)[k - 1]
    for other, marks in ((docs, labels), (docs, labels.limit(0)), (empty, labels)):
        keys, _, least = importance.resample(other, marks)
        assert keys.count() == other.count()


def test_importance_judges_each_length_by_its_own(spark):
    rng = np.random.default_rng(9)
    common, own, junk = ([f"{x}{i}" for i in range(400)] for x in "cgj")

    def text(n, other):
        at = rng.integers(0, 10**6, n)
        return " ".join((other if u < 0.35 else common)[i % (len(other) if u < 0.35 else len(common))] for i, u in zip(at, rng.random(n)))
    sizes = [(30, own, 1)] * 300 + [(3000, [*own, *(f"r{i}" for i in range(40_000))], 1)] * 130 + [(30, junk, 0)] * 200
    df = spark.createDataFrame([(i, text(n, o)) for i, (n, o, _) in enumerate(sizes)], "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(i, q) for i, (_, _, q) in enumerate(sizes)], "doc_id bigint, quality int")
    keys, _, least = importance.resample(df, labels)
    kept = {r.doc_id for r in keys.collect() if r.key >= least}
    assert len(kept & set(range(300, 430))) >= 0.95 * 130 and len(kept & set(range(300))) >= 0.9 * 300
    assert len(kept & set(range(430, 630))) <= 0.3 * 200


def test_mixing(spark, docs, empty):
    import pandas as pd
    rng = np.random.default_rng(3)
    dense = [(i, "word " * int(rng.integers(*((5, 90), (200, 700))[i % 2])), "xy"[i // 2 % 2], "ab"[int(rng.random() < 0.8)])
             for i in range(200)]
    found = mixing.sample_mix(spark.createDataFrame(dense, "doc_id bigint, text string, lang string, source string"))
    assert found.count() == len(dense)
    assert mixing.sample_mix(docs).count() == docs.count()
    got = found.select("__source", "__lang", "__topic", "__mass", "__rate").toPandas()
    cells = got.groupby(["__source", "__lang", "__topic"], as_index=False).agg(mass=("__mass", "sum"), rate=("__rate", "first"))
    w = cells.mass.astype(float).to_numpy().copy()
    goals = {}
    for m, power in (("__source", 0.5), ("__lang", 0.7), ("__topic", 1.0)):
        s = cells.groupby(m).mass.sum() ** power
        goals[m] = s / s.sum()
    for _ in range(200):
        for m, goal in goals.items():
            now = pd.Series(w).groupby(cells[m]).sum()
            w *= cells[m].map(goal / now).to_numpy()
    ratio = w / cells.mass
    low, high = 0.0, 1 / ratio.min()
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if (np.minimum(1, mid * ratio) * cells.mass).sum() < 0.5 * cells.mass.sum() else (low, mid)
    assert np.allclose(cells.rate, np.minimum(1, high * ratio), atol=1e-3)
    assert mixing.sample_mix(empty).count() == 0


def test_urls(spark):
    pages = [(1, "http://a.example.com/en/x?q"), (2, "https://www.example.com/en/"), (3, "http://x.net/es/1"), (4, None),
             (5, "nothing"), (6, "http://Bad.Host.org#top"), (7, "http:///p"), (8, "http://com/"), (9, "http://xcom/"),
             (10, "http://Bad.Host.org"), (10, "http://Bad.Host.org")]
    df = spark.createDataFrame(pages, "page_id bigint, url string")
    entries = spark.createDataFrame([("com", "/", "allow", 1), ("example.com", "/en/", "block", 1), ("net", "/es/", "block", 1),
                                     ("www.example.com", "/en/", "allow", 1), ("host.org", "", "block", 0), (None, "/", "block", 0)],
                                    "host string, path string, verdict string, tier int")
    got = {r.page_id: (r.host, r.path, r.entry, r.verdict) for r in urls.filter_urls(df, entries).collect()}
    assert got == {1: ("a.example.com", "/en/x", "example.com/en/", "block"), 2: ("www.example.com", "/en/", "www.example.com/en/", "allow"),
                   3: ("x.net", "/es/1", "net/es/", "block"), 4: ("", "", None, None), 5: ("", "", None, None),
                   6: ("bad.host.org", "", "host.org", "block"), 7: ("", "/p", None, None), 8: ("com", "/", "com/", "allow"),
                   9: ("xcom", "/", None, None), 10: ("bad.host.org", "", "host.org", "block")}
    assert urls.filter_urls(df, entries).count() == len(pages) and urls.filter_urls(df, entries.limit(0)).count() == len(pages)
    assert urls.filter_urls(df.limit(0), entries).count() == 0


def components(texts):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard(spark, docs, empty, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [(i, t) for i, t in enumerate(TEXTS)]
    for n in (6, 9, 14, 18, 40, 120):  # groups of edited copies round every size class
        base = rng.integers(0, 10**6, n).astype(str).tolist()
        for k in range(24):
            w = list(base)
            for _ in range(int(rng.integers(0, 3))):
                w[int(rng.integers(0, len(w)))] = f"e{rng.integers(0, 4)}"
            texts.append((len(texts), " ".join(w[:len(w) - int(rng.integers(0, 2))])))
    want = components(texts)
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4)
    for frequent in (1, 4, 1000):  # whichever tokens count as frequent, results are the same
        monkeypatch.setattr(jaccard, "FREQUENT", frequent)
        found, _ = jaccard.similarity_join(df)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == want
    kept = {r.doc_id for r in jaccard.drop_similar(df).collect()}
    assert kept == {i for i, (_, c) in want.items() if c == i}
    assert jaccard.similarity_join(docs)[0].count() == docs.count() and jaccard.similarity_join(empty)[0].count() == 0


def test_jaccard_pairs_with_a_passage_meet_once(spark):
    # ten members without links, each pair in the same 50 lists, and the same again for one member more
    rows = [(k, r, 4000, 10 + k, 0) for k in range(50) for r in range(10)] + [(k, r, 4000, 10 + k, 0) for k in range(50, 60) for r in range(11)]
    lists = spark.createDataFrame(rows, "key bigint, rep bigint, n bigint, place int, common int")
    none = spark.createDataFrame([], "id bigint, component bigint")
    tested = spark.createDataFrame([], "a bigint, b bigint")
    sketches = spark.createDataFrame([(r, None) for r in range(11)], "id bigint, sketch array<bigint>")
    nobody = spark.createDataFrame([], "rep bigint")
    shared = [(r.key, r.rep) for r in jaccard.first_of_equal(spark.createDataFrame(
        [(*x, 10 if x[0] < 50 else 11, x[0] >= 50, 7, x[0], None) for x in rows], "key bigint, rep bigint, n bigint, place int, common int, "
        "many int, digest boolean, check int, start int, loose boolean")).select("key", "rep").collect()]
    assert sorted(shared) == [(0, r) for r in range(10)] + [(50, r) for r in range(11)]
    met = jaccard.crossing_pairs(lists, none, tested, sketches, nobody)
    assert {tuple(r) for r in met.collect()} == {(a, b) for a in range(11) for b in range(a + 1, 11)}
    # a member that stands for several texts keeps all its lists
    assert {tuple(r) for r in jaccard.crossing_pairs(lists, none, tested, sketches, nobody.unionByName(
        spark.createDataFrame([(3,)], "rep bigint"))).collect()} == {(a, b) for a in range(11) for b in range(a + 1, 11)}


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(11)
    for n in (1, 8, 150, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for keep in (0, n // 2, n - 1, n):
            b = np.unique(np.concatenate([a[:keep], rng.integers(0, 1 << 63, n // 3).astype(np.uint64)]))
            odd = sum(int(x).bit_count() for x in (jaccard.sketch(a) ^ jaccard.sketch(b)).view(np.uint64))
            assert odd <= len(np.setxor1d(a, b))


def test_pipeline(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, at = at, stage(spark, at, SF)
        at = spark.createDataFrame(at.collect(), docs.schema)
        assert at.columns == docs.columns and 0 < at.count() <= before.count(), name
    out = corpus_pipeline.STAGES[-1][1](spark, at, SF)
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in at.collect()}
