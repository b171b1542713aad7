"""Conversation repair, personal data and centroid clustering against plain versions, on small tables with hard rows."""

import hashlib
import math
import random
import re
import zlib
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.llm import centroids, dialogue, disclosure, queries
from vigil.llm.dialogue import Costs, Merged, Row

# --- conversations ---------------------------------------------------------------------------------------------------


def plain_repair(rows, costs, inserts):
    """Every edit sequence with at most ``inserts`` insertions, as (cost, audit), the least of them."""
    best = None

    def walk(i, roles, cost, audit, left):
        nonlocal best
        if i == len(rows):
            if re.fullmatch(r"(s?(ua)+)?", roles):
                best = min(best or (cost, audit), (cost, audit))
        if left and i <= len(rows):
            for x in "ua":
                walk(i, roles + x, cost + costs.insert, audit + "I", left - 1)
        if i < len(rows):
            r = rows[i]
            walk(i + 1, roles, cost + costs.delete, audit + "D", left)
            if not r.must_go:
                more = costs.truncated * r.truncated
                walk(i + 1, roles + r.initial, cost + costs.keep + more, audit + "K", left)
                for x in "ua":
                    walk(i + 1, roles + x, cost + costs.rerole + more, audit + "R", left)

    walk(0, "", 0, "", inserts)
    return best


def random_rows(rng, n):
    return [Row(rng.choice("suuaat "), rng.random() < 0.2, rng.random() < 0.2) for _ in range(n)]


@pytest.mark.parametrize("costs", [Costs(), Costs(insert=1, delete=2), Costs(rerole=3, insert=2, delete=3), Costs(delete=0, insert=1)])
def test_least_integer_is_cheapest_then_ascii_least(costs):
    rng = random.Random(5)
    for n in (0, 1, 2, 3, 4, 5):
        for _ in range(12):
            rows = random_rows(rng, n)
            most = min(2, dialogue.insert_bound(n, costs))
            assert dialogue.best(dialogue.fold(rows, costs, most)) == plain_repair(rows, costs, most), rows


def test_more_insertions_change_nothing_at_the_default_costs():
    rng = random.Random(6)
    for _ in range(60):
        rows = random_rows(rng, rng.randrange(6))
        assert plain_repair(rows, Costs(), 3) == dialogue.best(dialogue.fold(rows, Costs(), 1))


def test_blocks_multiply_to_the_whole():
    rng = random.Random(7)
    for costs in (Costs(), Costs(insert=1, delete=3)):
        for n in (1, 7, 40):
            rows = [r._replace(must_go=False) for r in random_rows(rng, n)]
            merged, i = Merged(1), 0
            while i < n:
                step = rng.randrange(1, 6)
                merged.add(dialogue.fold(rows[i:i + step], costs, 1))
                i += step
            assert dialogue.best(merged.all()) == dialogue.best(dialogue.fold(rows, costs, 1))
    gone = [Row("u", True, False)] * 9
    assert dialogue.best(dialogue.deletions(9, Costs())) == dialogue.best(dialogue.fold(gone, Costs(), 1)) == (18, "D" * 9)


def plain_conversations(rows):
    """op11's rows, one conversation after the other, by a table of (cost, audit) and without insertions."""
    said = lambda v: " " if v is None else str(v)
    after = []
    for conv, turn, role, text, *_ in rows:
        hit, role, text = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20, said(role), said(text)
        if hit:
            text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
            after += [(conv, turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    out = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest())
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in after if r[0] == conv), key=key)
        n = {"blank": 0, "duplicate": 0, "truncated": 0}
        seen, facts = set(), []
        for _, _, role, text in own:
            shown = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                n[fault] += 1
            facts.append((role, fault))
        best = {"": (0, "", ())}
        for (role, fault), (_, _, _, text) in zip(facts, own, strict=True):
            new = {}

            def offer(state, cost, audit, kept, new=new):
                if state not in new or (cost, audit) < new[state][:2]:
                    new[state] = (cost, audit, kept)

            for state, (cost, audit, kept) in best.items():
                offer(state, cost + 2, audit + "D", kept)
                if fault in ("blank", "duplicate"):
                    continue
                more = 5 if fault else 0
                for letter, name, price in (("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)):
                    if (state, name[:1]) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                        offer(name[:1], cost + price + more, audit + letter, (*kept, f"{name}:{text}"))
            best = new
        cost, audit, kept = min(v for k, v in best.items() if k in ("", "a"))
        turns = [r[1] for r in own if r[1] is not None]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n["blank"], n["duplicate"], n["truncated"],
                     sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False)),
                     cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def conversation_rows():
    rng = random.Random(9)
    roles, ends = ["system", "user", "user", "assistant", "assistant", "tool", "", None], [".", "!", "?", "", " ", "\n"]
    rows = []
    for conv in [*range(40), None]:
        for turn in range(rng.randrange(1, 9)):
            text = rng.choice([None, "", "  ", "Yes.", "ok", "é漢\U0001f600 " + "w" * rng.randrange(5) + rng.choice(ends)])
            rows.append((conv, rng.choice([turn, turn, turn + 3, None]), rng.choice(roles), text, "x", 1))
    rows += [(900, i, ("user", "assistant")[i % 2], f"turn {i}." if i % 7 else "again.", "x", 1) for i in range(1500)]  # over several blocks
    rows += [(901, 4, "user", "the same.", "x", 1)] * 700 + [(901, 5, "assistant", "x" * 60_000 + ".", "x", 1)]
    return rows


CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string, audit string, `#hit` int"


def test_conversations(spark, tmp_path):
    rows = conversation_rows()
    spark.createDataFrame(rows, CONVERSATIONS).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op11_dialogue(spark, str(tmp_path)).collect()
    want = plain_conversations(rows)
    assert {r.conv_id: tuple(r)[1:] for r in got} == want and len(got) == len(want)
    spark.createDataFrame([], CONVERSATIONS).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert queries.op11_dialogue(spark, f"{tmp_path}/none").count() == 0


def test_repaired_turns(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "So."), (1, 2, "tool", "Fine."), (1, 3, "assistant", "")],
                                 "conv long, turn long, role string, text string")
    got = sorted(map(tuple, dialogue.repaired_turns(rows).collect()))
    assert got == [(1, 0, "K", "user", "So."), (1, 1, "R", "assistant", "Fine.")]  # DKRD
    with pytest.raises(ValueError):
        dialogue.repair(rows, rows, Costs(insert=1))


# --- personal data ---------------------------------------------------------------------------------------------------

def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        c = int(c) * (1 + i % 2)
        total += c - 9 * (c > 9)
    return total % 10 == 0


def plain_values(text):
    def good(kind, m):
        d = re.sub("[^0-9]", "", m)
        return (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.split(".")) or kind == "phone" and 10 <= len(d) <= 15
                or kind == "card" and 14 <= len(d) <= 19 and luhn(d))
    return sorted((m.start(), nr, m.end(), kind) for nr, (kind, p) in enumerate(disclosure.GIVEN.items())
                  for m in re.finditer(p, text or "", re.ASCII) if good(kind, m.group()))


def random_texts():
    rng = random.Random(3)
    parts = ["a@b.c", "@", "x.y+z@d-e.fg.", "._", "\U0001f600", "é", " ", "  ", "-", "\n", "1", "22", "255.1.2.3", "256.1.1.1", "001.02.3.4.5",
             ".", "+1 (212) 555-0199", "+", "+49", "()", "4111 1111 1111 1111", "4111-1111-1111-1112", "3782822463100055", "0" * 15, "a", "Maria"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(600)]
    many = " ".join(f"u{i}@h{i}.org 10.0.{i % 256}.1" for i in range(2000))
    return [None, "", "a@b", "a@b.c.", "a@b@c.d", "a@b.c+d@e.f", "a@b.c._x@d.e", "1.2.3.4.5.6.7.8", "12 -34", *out, many]


#: Texts on which a pattern that tries every place anew takes minutes, and how many values they hold.
LONG = {"a" * 200_000: 0, "a." * 100_000 + "@": 0, "1 " * 100_000: 0, "+" + "1(" * 100_000: 0, "+1" * 50_000: 0, "x@" + "y." * 50_000: 1}


def test_values_equal_the_patterns_as_given(spark):
    texts = random_texts()
    df = spark.createDataFrame(list(enumerate([*texts, *LONG])), "i long, text string").repartition(8)
    got = df.select("i", disclosure.values(F.coalesce("text", F.lit(""))).alias("s")).collect()
    for r in got:
        if r.i < len(texts):
            assert [(s.start, s.nr, s.end, s.kind) for s in r.s] == plain_values(texts[r.i]), (texts[r.i] or "")[:300]
    assert {r.i - len(texts): len(r.s) for r in got if r.i >= len(texts)} == dict(enumerate(LONG.values()))


def plain_disclosing(texts):
    """Terms over the threshold, by counting rows one by one."""
    near, holds, contexts, n_e, n_t = {}, {}, {}, {}, {}
    spelled = {"email": str.lower, "ip": str, "card": lambda v: re.sub("[^0-9]", "", v), "phone": lambda v: re.sub("[^0-9]", "", v)}
    for text in texts:
        text = text or ""
        words = {w.lower() for w in re.findall(r"[^\W_]{3,}", text)}
        for w in words:
            n_t[w] = n_t.get(w, 0) + 1
        found, spots, surroundings = plain_values(text), {}, []
        for a, _, b, kind in found:
            all_of_kind = [m.span() for m in re.finditer(disclosure.GIVEN[kind], text, re.ASCII)]
            if kind == "card":  # other runs of digits do not bound a card's surroundings
                all_of_kind = [s for s in all_of_kind if 14 <= len(re.sub("[^0-9]", "", text[s[0]:s[1]])) <= 19]
            left = max((e for _, e in all_of_kind if e <= a), default=0)
            right = min((s for s, _ in all_of_kind if s >= b), default=len(text))
            before, after = text[max(left, a - disclosure.WINDOW):a], text[b:min(right, b + disclosure.WINDOW)]
            entity = f"{kind}:{spelled[kind](text[a:b])}"
            surroundings.append((before, entity, after))
            if len(before) == disclosure.WINDOW:
                before = re.sub(r"^[^\W_]+", "", before)
            if len(after) == disclosure.WINDOW:
                after = re.sub(r"[^\W_]+\Z", "", after)
            spots.setdefault(entity, set()).update(w.lower() for w in re.findall(r"[^\W_]{3,}", before + "\n" + after))
        for entity, terms in spots.items():
            n_e[entity] = n_e.get(entity, 0) + 1
            for t in terms:
                near[entity, t] = near.get((entity, t), 0) + 1
                contexts.setdefault((entity, t), set()).add(tuple(surroundings))
    n = len(texts)
    return {t for (e, t), k in near.items() if len(contexts[e, t]) >= disclosure.CONTEXTS and n_e[e] < n
            and math.log2(k * n / (n_e[e] * n_t[t])) / math.log2(n / n_e[e]) >= disclosure.DISCLOSURE}


def corpus():
    rng = random.Random(8)
    common = "the people there were going home after work because rain came down over town".split()
    line = lambda k: " ".join(rng.choice(common) for _ in range(k))
    texts = [line(30) for _ in range(150)]
    texts += [f"{line(4)} write to Zephyrine at zq.{'A' if i % 2 else 'a'}7@mail.example.org or call {line(5)}" for i in range(8)]
    texts += [f"{line(12)} mail zq.a7@mail.example.org {line(3)} quokkas" for _ in range(5)]      # 'mail' and 'quokkas' stand near it too
    texts += [f"{line(6)} quokkas {line(4)}" for _ in range(20)]                                 # but most quokkas stand elsewhere
    copy = f"{line(5)} Brindlewax lives near 10.20.30.40 {line(5)}"
    texts += [copy] * 9                                                                        # one text copied tells nothing
    return [*texts, f"{line(9)} Zephyrine was here", None, ""]


def test_disclosing_terms(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, t string, `#digest` int").repartition(4)
    want = plain_disclosing(texts)
    assert "zephyrine" in want and not {"quokkas", "brindlewax", "the"} & want
    out = disclosure.find_personal(df)
    assert out.columns == [*df.columns, "personal"]
    rows = out.withColumn("clean", disclosure.sanitized(F.coalesce("text", F.lit("")), F.col("personal"))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text, spans = r.text or "", [(s.start, s.end, s.kind) for s in r.personal]
        base = plain_values(text)
        terms = [(m.start(), m.end(), "term") for m in re.finditer(r"[^\W_]{3,}", text) if m.group().lower() in want
                 and not any(a < m.end() and m.start() < b for a, _, b, _ in base)]
        assert spans == sorted([(a, b, k) for a, _, b, k in base] + terms)
        assert "zq.a7@" not in r.clean and "Zephyrine" not in r.clean
        if "Zephyrine was here" in text:
            assert r.clean.endswith("[name] was here")
    assert disclosure.find_personal(df.limit(0)).count() == 0


def test_sanitized(spark):
    text = "é\U0001f600 call +1 (212) 555-0199 4111 1111 1111 1111 " + " ".join(f"u{i}@h.org" for i in range(700)) + " end"
    df = spark.createDataFrame([(text,), ("none",), ("+4111111111111111",)], "text string")
    df = df.select("text", F.transform(disclosure.values(F.col("text")), lambda s: F.struct(
        s["start"], s["nr"], s["end"], s["kind"], F.concat(F.lit("["), s["kind"], F.lit("]")).alias("put"))).alias("p"))
    clean = [r[0] for r in df.select(disclosure.sanitized(F.col("text"), F.col("p"))).collect()]
    assert clean[0].endswith(" ".join(["[email]"] * 700) + " end") and clean[1] == "none" and clean[2].startswith("+")
    found = plain_values(text)
    groups, end = [], -1
    for a, _, b, kind in found:
        if a < end:
            groups[-1][1] = max(groups[-1][1], b)
        else:
            groups.append([a, b, kind])
        end = max(end, b)
    want, at = "", 0
    for a, b, kind in groups:
        want += text[at:a] + f"[{kind}]"
        at = b
    assert clean[0] == want + text[at:]


# --- centroids -------------------------------------------------------------------------------------------------------

def plain_clusters(rows, k=8, rounds=10, dims=64):
    good = [(i, [math.floor(1024 * x) if abs(x) < 2**53 else int(x) * 1024 for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    centers = [list(v) for _, v in sorted(good, key=lambda r: (name(r[0]), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(centers))
    for _ in range(rounds):
        own = [[] for _ in centers]
        for _, v in good:
            own[near(v)[1]].append(v)
        centers = [[sum(x) // len(vs) for x in zip(*vs, strict=True)] if vs else c for vs, c in zip(own, centers, strict=True)]
    out = [(i, *near(v)) for i, v in good]
    fits = lambda v: v if v < 1 << 63 else None
    by = lambda c: sum(d for _, d, x in out if x == c)
    return sorted([(str(i), c, fits(d), fits(by(c)), fits(sum(d for _, d, _ in out)), hashlib.sha256(",".join(map(str, centers[c])).encode()).hexdigest())
                   for i, d, c in out], key=repr)


def vectors(rng, n, dims=64):
    return [(i, [float(np.float32(x)) for x in rng.normal(size=dims) / 8 + (i % 5) / 4]) for i in range(n)]


@pytest.mark.parametrize("case", ["hard", "few", "large"])
def test_centroids(spark, case):
    rng = np.random.default_rng(2)
    rows = vectors(rng, 6 if case == "few" else 300)
    rows += [rows[3]] * 5 + [(3, rows[4][1]), (None, rows[5][1]), (900, [0.0] * 64), (901, [0.0] * 64)] if case != "few" else []
    rows += [(910, None), (911, []), (912, [1.0] * 63), (913, [1.0] * 65), (914, [1.0] * 63 + [None]), (915, [math.nan] * 64), (916, [math.inf] + [0.0] * 63)]
    if case == "large":
        rows += [(920, [3e38] * 64), (921, [-3e38] * 64), (922, [70000.5] * 64), (923, [-1e-30] * 64)]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<float>, cluster int, id int").repartition(3)
    rows = [(r[0], r[1]) for r in df.collect()]
    got = sorted([(str(r[0]), *r[1:]) for r in map(tuple, centroids.cluster_vectors(df).collect())], key=repr)
    assert got == plain_clusters(rows)
    assert centroids.cluster_vectors(df.limit(0)).count() == 0


def test_walk_stops_early_and_keeps_ties():
    rng = np.random.default_rng(4)
    for k, dims in ((1, 1), (8, 64), (60, 2), (9, 3)):
        c = rng.integers(-4, 4, (k, dims)).tolist()
        x = rng.integers(-5, 5, (500, dims))
        label, best, read = centroids.SortedLists(c).nearest(x)
        apart = ((x[:, None, :] - np.array(c)[None]) ** 2).sum(axis=2)
        assert (label == apart.argmin(axis=1)).all() and (best == apart.min(axis=1)).all()
        if k == 60:
            assert read < 0.7 * x.size * k


def test_first_turns_of_hot_conversations_come_as_one_row(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi.")] * 500 + [(1, 1, "assistant", "Yes.")], "conv long, turn long, role string, text string")
    runs = {r.copies for r in dialogue.counted(rows).collect()}
    assert runs == {500, 1}
    assert [len(list(g)) for _, g in groupby(dialogue.repair(rows, rows).first().audit)] == [1, 499, 1]


# --- kept in order: quality and similar texts ------------------------------------------------------------------------

def test_texts_without_words_are_never_good(spark):
    from vigil.llm import importance
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(1_000_000 + i, (None, "", " \n")[i % 3]) for i in range(200)], "doc_id long, text string")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for table in (labels, labels.limit(0)):
        keys, _, least = importance.resample(docs.unionByName(more), table)
        kept = {r.doc_id for r in keys.where(F.col("key") >= least).select("doc_id").collect()}
        assert kept and not any(i >= 1_000_000 for i in kept)


def test_held_tokens():
    from vigil.llm.jaccard import Held
    rng = np.random.default_rng(1)
    held = Held(100)
    for n in (0, 1, 90, 400, 7):
        tokens = [rng.integers(0, 60, n).astype(np.uint64) for _ in range(3)]
        for t in tokens:
            held.add(t)
        want, times = np.unique(np.concatenate(tokens), return_counts=True)
        got, counts = held.repeated()
        assert got.tolist() == want[times > 1].tolist() and counts.tolist() == times[times > 1].tolist() and held.size == 0
