"""The operators held against brute force and planted cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import knmodel, op1_html, op2_toxicity, op3_mixing, op4_langid, op6_quality, op7_pii, op8_fingerprints, op9_chat, op10_decontamination
from ledgerline.llm.common import scratch

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d * 2 - 9 * (d > 4) if i % 2 else d for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def scanned(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (13 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_toxicity_probabilities_equal_brute_force_and_sum_to_one(spark):
    rng = random.Random(1)
    texts = [("".join(rng.choice("abé ") for _ in range(60)), i % 2) for i in range(12)]
    rows = spark.createDataFrame(texts, "text string, toxic int").withColumns({"fold": F.lit(0), "fit": F.lit(True)})
    last = op2_toxicity.FOLDS
    with scratch(spark) as staged:
        g, _ = op2_toxicity.counted(rows)
        out = op2_toxicity.spelling(staged(g), staged).select("g", "q", f"p0_{last}", f"p1_{last}", f"l0_{last}", f"l1_{last}").collect()
    count = [Counter(), Counter()]
    for t, c in texts:
        x = "".join(map(chr, knmodel.spelled(t)))
        count[c].update(x[i : i + 5] for i in range(len(x) - 4))
    levels = {5: set(count[0]) | set(count[1])}
    tally = {}
    for k in (4, 3, 2, 1):
        tally[k] = Counter(s[1:] for s in levels[k + 1])
        levels[k] = set(tally[k])

    def disc(n):
        once, twice = sum(v == 1 for v in n), sum(v == 2 for v in n)
        return min(0.95, max(0.1, once / max(1, once + 2 * twice)))

    def low(s):
        t = tally[len(s)]
        if len(s) == 1:
            return (t[s] + 1) / (sum(t.values()) + len(t) + 1)
        same = [v for k, v in t.items() if k[:-1] == s[:-1]]
        d = disc(t.values())
        return (t[s] - d + d * len(same) * low(s[1:])) / sum(same)

    assert {r.g for r in out} == levels[5]
    mass = defaultdict(float)
    for r in out:
        assert r.q == pytest.approx(low(r.g[1:]))
        for c in (0, 1):
            same = [v for k, v in count[c].items() if k[:-1] == r.g[:-1]]
            d, n = disc(count[c].values()), sum(same)
            want = max(count[c][r.g] - d, 0) / n + d * len(same) / n * low(r.g[1:]) if n else low(r.g[1:])
            assert r[f"p{c}_{last}"] == pytest.approx(want, rel=1e-4)
            mass[c, r.g[:-1]] += r[f"p{c}_{last}"] - r[f"l{c}_{last}"] * r.q
    for r in out:
        for c in (0, 1):
            assert mass[c, r.g[:-1]] + r[f"l{c}_{last}"] == pytest.approx(1, rel=1e-4)


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (None, "", "b"), (3, "x " * 600_000, "c")], "doc_id long, text string, x string")
    assert [r.predicted for r in op2_toxicity.score(docs, None).collect()] == [0] * 4
    train = spark.createDataFrame([(f"w{i} good day", i % 2) if i % 2 == 0 else (f"w{i} vile scum", 1) for i in range(60)], "text string, toxic int")
    model = op2_toxicity.train(train)
    out = op2_toxicity.score(docs, model)
    assert out.columns == ["doc_id", "text", "x", "score", "predicted"] and out.count() == 4
    assert all(0 <= r.score <= 1 for r in out.collect()) and op2_toxicity.score(docs.where("false"), model).count() == 0
    assert op2_toxicity.train(train.where("toxic = 1")) is None and op2_toxicity.train(train.where("false")) is None
    # Pieces of a long text give what the whole gives.
    pair = knmodel.unpacked(model[0])
    assert knmodel.features("vile scum " * 10, pair)[5] > knmodel.features("good day " * 10, pair)[5]


def test_mixing_equals_brute_force(spark):
    rows = [(5, "a b c d e f g h i j", "s")] * 300 + [(None, None, None)] * 3 + [(7, "x y", "t")] * 5 + [(i, "w " * i, None) for i in range(40)]
    out = op3_mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))).collect()
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    left = 1.5 * sum(size.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        stop = {s for s in open_ if share[s] >= 2 * size[s]}
        for s in stop or open_:
            target[s] = 2 * size[s] if stop else share[s]
            left -= target[s]
        open_ -= stop or open_
    taken = Counter()
    for r in out:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source_size, round(r.target, 6)] += r.taken
    assert {(size[s], round(target[s], 6)) for s in order} == set(taken)
    assert all(abs(n - t) < 1 for (_, t), n in taken.items())


def test_six_languages_and_clashing_columns(spark):
    rng = random.Random(2)
    words = {f"l{k}": ["".join(rng.choice("abcdefghij"[k : k + 5]) for _ in range(4)) for _ in range(30)] for k in range(6)}
    rows = [(" ".join(rng.choice(w) for _ in range(30)), lang, "kept") for lang, w in words.items() for _ in range(30)]
    docs = spark.createDataFrame(rows, "text string, lang string, x string")
    out = op4_langid.predict(docs, op4_langid.train(docs)).collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.95 and {r.x for r in out} == {"kept"}
    assert all(0 <= r.score <= 1 for r in out)
    assert [r.lang_pred for r in op4_langid.predict(spark.createDataFrame([(None,), ("1 2",)], "text string"), op4_langid.train(docs)).collect()] == ["und", "und"]


def test_quality_posteriors_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(("fine words stand here", "@@ buy $$ now !!")[i % 2].split() * rng.randrange(1, 6)), f"h{i % 3}", None if i % 4 else "p") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)], "doc_id long, quality int")
    model = op6_quality.train(op6_quality.labelled(docs, labels))
    out = op6_quality.score(docs, model).join(docs, "doc_id").collect()
    assert all(r.predicted == 1 - r.doc_id % 2 for r in out) and len(out) == 60
    mu = np.mean([r.evidence for r in out])
    by = defaultdict(list)
    for r in out:
        by[r.source].append(r.evidence)
    # A host's posterior lies between its own mean and the global one.
    for r in out:
        m = np.mean(by[r.source])
        assert min(m, mu) - 1e-9 <= r.host_posterior <= max(m, mu) + 1e-9
    assert op6_quality.train(op6_quality.labelled(docs, labels.where("false"))) is None


def test_pii_equals_plain_scan(spark):
    rng = random.Random(4)
    alphabet = ["@", ".", "+", "-", " ", "_", "a", "b.c", "x@y.zz", "1", "23", "4111 1111 1111 1111", "10.0.0.7", "+44 20 7946 0958", "é", "😀", "1.2.3.4.5"]
    texts = ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(300)] + [None, "", "1" * 100_000, "1 " * 50_000, "a@b" * 2000, "a" * 100_000, "+1" + " " * 50_000]
    docs = spark.createDataFrame([(i % 50, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("email", F.lit(1))
    out = op7_pii.spans(docs).select("text", op7_pii.joined_spans(op7_pii.PATTERNS).alias("s")).collect()
    assert len(out) == len(texts)
    for r in out:
        assert r.s == ",".join(scanned(r.text)), r.text[:200]


def test_pii_method_adds_disclosing_terms(spark):
    """`zanzibar` stands in documents of one address, among other words each time."""
    rng = random.Random(5)
    words = [f"{a}{b}or" for a in "bcdfghlm" for b in "aeiou"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(30)) + (" write to jo@example.com about Zanzibar " + rng.choice(words) if i % 20 == 0 else "")) for i in range(200)]
    rows = [(i, t.replace("about", rng.choice(words))) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = op7_pii.spans(docs).collect()
    found = {s.value for r in out for s in r.pii_term}
    assert "Zanzibar" in found and len(found) <= 3
    clean = {r.doc_id: r.text for r in op7_pii.redact(docs).collect()}
    assert "Zanzibar" not in clean[0] and "[EMAIL]" in clean[0] and clean[1] == rows[1][1]


def told_plainly(rows, entity):
    """(row, start, end) of the words that disclose an entity, counted in plain Python over all pairs."""
    words = [[(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{3,}", t)] for t in rows]
    total, holds, where = Counter(t for w in words for t, _, _ in w), Counter(), {}
    for i, text in enumerate(rows):
        for x in set(re.findall(entity, text)):
            holds[x] += 1
            for j, (t, _, _) in enumerate(words[i]):
                where.setdefault((x, t), []).append((i, j))
    cuts = set()
    for (x, t), at in where.items():
        left = {words[i][j - 1][0] if j else None for i, j in at}
        right = {words[i][j + 1][0] if j + 1 < len(words[i]) else None for i, j in at}
        share = len(at) / total[t] * (1 - 1 / min(len(left), len(right)))
        if share >= op7_pii.SHARE and math.log2(share * len(rows) / holds[x]) >= op7_pii.BITS:
            cuts |= {(i, *words[i][j][1:]) for i, j in at}
    return {(i, a, b) for i, a, b in cuts if not any(m.start() < b and a < m.end() for m in re.finditer(entity, rows[i]))}


def test_pii_terms_equal_plain_counts(spark):
    """Entities of one document and of several, a word that is part of an address too."""
    rng = random.Random(11)
    common = [f"{a}{b}n" for a in "bcdfghlmprst" for b in "aeiou"]
    rows = [" ".join(rng.choice(common) for _ in range(40)) for _ in range(150)]
    for i in (3, 40):
        said = " ".join(f"{rng.choice(common)} Quillon {rng.choice(common)}" for _ in range(5))
        rows[i] = f"quillon{i}@mail.org {said} Quillon quillon{i}@mail.org ask quillon"
    rows[70] = " ".join(f"{rng.choice(common)} Tarvik {rng.choice(common)}" for _ in range(6)) + " solo@mail.org other@mail.org"
    for i in (90, 91, 92):
        rows[i] += f" pair@mail.org {rng.choice(common)} Ombrel {rng.choice(common)} Ombrel {rng.choice(common)}"
    entity = r"[a-z0-9]+@mail\.org"
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {(r.doc_id, s.start, s.end) for r in op7_pii.spans(docs).collect() for s in r.pii_term}
    want = told_plainly(rows, entity)
    assert found == want
    assert {rows[i][a:b] for i, a, b in want} >= {"Tarvik", "Ombrel"}


def test_pii_redaction_equals_plain_cuts(spark):
    """Overlapping, adjacent and far spans, over several blocks of cuts and pieces, beyond the basic plane too."""
    rng = random.Random(12)
    bits = ["a@b.cc", "+44 20 7946 0958", "4111 1111 1111 1111", "10.0.0.7", "+4111 1111 1111 1111", "1.2.3.4@x.yz", "😀é ", " or ", "x" * 300]
    texts = ["".join(rng.choice(bits) + " " * rng.randrange(3) for _ in range(n)) for n in (1, 5, 30, 900)] * 2 + [None, "", "plain"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: r for r in op7_pii.spans(docs).collect()}
    out = {r.doc_id: r.text for r in op7_pii.redact(docs).collect()}
    for i, text in enumerate(texts):
        kept, at = [], 0
        for a, b, kind in sorted((s.start, s.end, k) for k in ("email", "ip", "card", "phone", "term") for s in spans[i][f"pii_{k}"]):
            if a >= at:
                kept += [text[at:a], "" if kind == "term" else f"[{kind.upper()}]"]
            at = max(at, b)
        assert out[i] == (None if text is None else "".join(kept) + text[at:])


def test_short_items_are_found_as_whole_words_only():
    index = op10_decontamination.Index(["yes", "c++", "東京", "3 + 4", "été", ""])
    held = {"Yes, indeed": [0], "eyes": [], "yesterday or yes_no": [], "say (yes)": [0], "c++ code": [1], "c++11": [1], "abc++": [], "在東京都": [2], "is 3 + 4 = 7": [3], "13 + 4": [], "cet été-là": [4], "étés": [], "": [], None: []}
    assert {t: index.matches(t) for t in held} == held


def test_fingerprints_equal_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(40)))) for i in range(60)] + [(60, None), (61, "")]
    out = {r.doc_id: r for r in op8_fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    error = []
    for k, (i, t) in enumerate(rows):
        a, b = t or "", rows[(k + 1) % len(rows)][1] or ""
        edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        assert out[i].n_chars == len(a) and out[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        x, y = Counter(a.split()), Counter(b.split())
        if x and y:
            error.append(out[i].near_next - sum((x & y).values()) / sum((x | y).values()))
    assert abs(np.mean(error)) < 0.03 and np.std(error) < 0.06


def edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination_equals_brute_force():
    rng = random.Random(7)
    for _ in range(200):
        item = op10_decontamination.normal("".join(rng.choice("abcd ") for _ in range(rng.choice((12, 20, 45, 80)))))
        if len(item) < 8:
            continue
        most, x = min(int(0.08 * len(item)), (len(item) - 8) // 8), list(item)
        for _ in range(rng.randrange(most + 3)):
            k, r = rng.randrange(len(x)), rng.random()
            x[k : k + 1] = ["z"] if r < 0.3 else [x[k], "y"] if r < 0.6 else []
        text = op10_decontamination.normal("".join(rng.choice("abcd") for _ in range(rng.randrange(60))) + "".join(x) + "".join(rng.choice("abcd") for _ in range(rng.randrange(60))))
        assert bool(op10_decontamination.Index([item]).matches(text)) == (edits(item, text) <= most)


def test_decontamination_odd_rows(spark):
    item = "the quick brown fox jumps over the lazy dog while seven wizards quietly brew"
    docs = spark.createDataFrame([(1, f"x {item} y", "k"), (None, item, "k"), (3, "a" * 200_000, "k"), (4, None, "k")], "doc_id long, text string, items string")
    bench = spark.createDataFrame([(None, item), (5, "a" * 45), (6, "a" * 45), (7, None)], "item_id long, text string")
    kept = op10_decontamination.decontaminate(docs, bench)
    assert kept.columns == docs.columns and [(r.doc_id, r["items"]) for r in kept.collect()] == [(4, "k")]
    for chars in (1_000_000, 50):
        out = {r.doc_id: r["items"] for r in op10_decontamination.contaminated(docs, bench, block_chars=chars).where("contaminated").collect()}
        assert out == {1: [], None: [], 3: [5, 6]}
    assert op10_decontamination.decontaminate(docs, bench.where("false")).count() == 4


def test_html_odd_markup():
    page = "<html><head><title>t</title><body><article><p>one<![foo bar]> two</p><button>b<p>three</p></article>"
    assert [b[2] for b in op1_html.blocks(page)] == ["one two", "three"]


def test_chat_reads_calls_after_any_white_space(spark):
    rows = [(1, 0, "assistant", '\n\t {"tool_calls": [{"id": "a", "name": "fetch", "arguments": "{\\"url\\": 1}"}]}'), (1, 1, "tool", '\r\n{"tool_call_id": "a"}')]
    out = {r.turn: r for r in op9_chat.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert out[0].problems == ["url is not string"] and out[1].call_turn == 0 and not out[1].orphan
