"""Small fixtures: brute force, planted cases, nulls, ties, empty tables and extra columns."""

import json

import pytest

from ledgerline.llm import op1_html, op3_mixing, op5_simhash, op7_pii, op8_fingerprints, op9_chat, op10_decontamination

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def docs(spark):
    rows = [(i, " ".join(WORDS[(i * 7 + j * (i + 3)) % 20] for j in range(5 + i)), f"s{i % 3}" if i % 5 else None, "en", 0) for i in range(40)]
    rows += [(100 + i, rows[30][1], "s0", "en", 0) for i in range(5)] + [(200, None, "s1", None, None), (201, "", "s1", "en", 0), (None, "alone here", "s2", "en", 0)]
    return spark.createDataFrame(rows, SCHEMA)


def test_mixing_targets_and_limits(spark):
    out = op3_mixing.mix(docs(spark)).collect()
    assert len(out) == 48 and all(0 <= r.taken <= 2 * r.size for r in out)
    assert sum({r.target for r in out}) == pytest.approx(1.5 * sum(r["size"] for r in out))
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, op3_mixing.mix(docs(spark).repartition(7)).collect()), key=str)


def test_simhash_components_equal_brute_force(spark):
    out = op5_simhash.near_duplicates(docs(spark).where("doc_id is not null")).collect()
    values, ids = [int(r.fingerprint, 16) for r in out], [r.doc_id for r in out]
    least = dict(enumerate(ids))
    for _ in ids:
        for i, x in enumerate(values):
            least[i] = min(least[j] for j, y in enumerate(values) if (x ^ y).bit_count() <= 3)
    assert {r.doc_id: r.component_id for r in out} == {ids[i]: v for i, v in least.items()}


def test_pii_spans_and_redaction(spark):
    text = "Mail bob@example.com or +44 20 7946 0958, card 4111 1111 1111 1111, ip 10.0.0.256 and 10.0.0.7"
    one = spark.createDataFrame([(1, text, "s", "en", len(text)), (2, None, "s", "en", None)], SCHEMA)
    r = {x.doc_id: x for x in op7_pii.spans(one).collect()}
    assert [len(r[1][f"pii_{k}"]) for k in ("email", "ip", "card", "phone")] == [1, 1, 1, 1]
    assert text[r[1].pii_email[0].start : r[1].pii_email[0].end] == "bob@example.com"
    clean = {x.doc_id: x.text for x in op7_pii.redact(one).collect()}
    assert clean[2] is None and "bob@" not in clean[1] and "[CARD]" in clean[1] and "10.0.0.256" in clean[1]


def test_fingerprints(spark):
    out = {r.doc_id: r for r in op8_fingerprints.fingerprints(docs(spark)).collect()}
    assert len(out) == 48 and len({out[100 + i].fingerprint for i in range(5)}) == 1
    assert out[100].near_next == 1.0


def test_decontamination_finds_edited_passages(spark):
    item = "the quick brown fox jumps over the lazy dog while seven wizards quietly brew a violet potion"
    edited = item.replace("quietly", "quietley").upper()
    rows = [(1, f"before {item} after", "s", "en", 0), (2, f"xx {edited} yy", "s", "en", 0), (3, "nothing of the kind", "s", "en", 0), (4, None, "s", "en", 0)]
    found = op10_decontamination.decontaminate(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(7, item), (8, None)], "item_id long, text string"))
    assert sorted(r.doc_id for r in found.collect()) == [3, 4]


def test_chat_links_results_after_calls(spark):
    call = json.dumps({"tool_calls": [{"id": "a", "name": "search", "arguments": '{"limit": "x"}'}]})
    rows = [(1, 0, "tool", json.dumps({"tool_call_id": "a", "content": "r"})), (1, 2, "assistant", call), (1, 3, "tool", '{"tool_call_id": "zz"}'), (None, None, None, None)]
    out = {(r.conv_id, r.turn): r for r in op9_chat.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(out) == 4 and (out[1, 0].rank_turn, out[1, 0].rank_step) == (2, 1)
    assert out[1, 3].orphan and set(out[1, 2].problems) == {"missing query", "limit is not number"}


def test_html_blocks():
    page = "<body><nav><a href=x>menu</a></nav><article><h1>T &amp; U</h1><p>One <b>two</b>\n three.<p>Four<script>x</script></article><footer>f</footer>"
    found = op1_html.blocks(page)
    assert [b[2] for b in found] == ["menu", "T & U", "One two three.", "Four", "f"]
    assert [op1_html.mark(b) for b in found] == [0, 1, 1, 1, 0] and op1_html.blocks(None) == []


def test_empty_tables(spark):
    none = docs(spark).where("false")
    assert op3_mixing.mix(none).count() == 0 and op5_simhash.near_duplicates(none).count() == 0
    assert op7_pii.spans(none).count() == 0 and op8_fingerprints.fingerprints(none).count() == 0


def test_full_sampler_keeps_frequent_words_and_all_signatures(monkeypatch):
    texts = [f"often seen words w{i} x{i} y{i}" for i in range(60)] + ["b a c", "c b a", ""]
    plain = [op8_fingerprints.Sampler(16).signature(t).tolist() for t in texts]
    monkeypatch.setattr(op8_fingerprints, "KEPT", 16)
    drawn, sampler = [], op8_fingerprints.Sampler(16)
    draw = sampler.draw
    monkeypatch.setattr(sampler, "draw", lambda words: (drawn.extend(words), draw(words)))
    assert [sampler.signature(t).tolist() for t in texts] == plain
    assert drawn.count("often") == 1 and len(sampler.ids) <= 16


def test_equal_bags_are_alike_when_words_draw_equal_values():
    sampler = op8_fingerprints.Sampler(16)
    sampler.signature("a b c d")
    sampler.once[:] = 0
    assert sampler.signature("d c b a").tolist() == sampler.signature("a b c d").tolist()
    assert sampler.sampled({"d": 1, "a": 1}, False) is None


def test_words_are_what_the_pattern_finds():
    every = "".join(map(chr, range(0x30000)))
    for text in (every, every[:128], "x".join(every[:128]), "x".join(every[::7]), "Don't  stop_1\x1cÄÖ\u0130 naïve 中文\u3000", ""):
        assert op8_fingerprints.words_of(text) == op8_fingerprints.WORD.findall(text.lower())
