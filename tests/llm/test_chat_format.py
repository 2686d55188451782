import hashlib
import random

import pytest

from lumenframe.llm import chat_format as cf


def test_escaping_is_reversible():
    r = random.Random(1)
    parts = [*cf.CONTROL, "\\", "[", "<", "]", "INST]", "/s>", "x", "é", "\n"]
    seen = set()
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(9)))
        escaped = cf.escape(text)
        assert cf.unescape(escaped) == text
        assert not any(c in escaped for c in cf.CONTROL)
        seen.add((text, escaped))
    assert len({e for _, e in seen}) == len({t for t, _ in seen})
    assert cf.escape("plain \\ text") == "plain \\ text"


def test_segments_read_back():
    r = random.Random(2)
    for _ in range(500):
        role = r.choice(["user", "assistant", "system", "", "[ROLE]", "a[/ROLE]b", "assistant "])
        text = "".join(r.choice([*cf.CONTROL, "<", "</s", "[/INST", "\\", "word "]) for _ in range(6))
        body = f"{cf.escape(text)}</s>" if role == "assistant" else f"[INST]{cf.escape(text)}[/INST]"
        assert cf.parse_segment(f"<s>[ROLE]{cf.escape(role)}[/ROLE]{body}") == (role, text)


def brute(rows):
    """rows in order: conv_id, role, text."""
    out = {}
    for conv, role, text in rows:
        x = out.setdefault(conv, [0, b"", ""])
        x[0] += 1
        x[1] += f"{role or ''}\n{text or ''}\n".encode()
        x[2] += (text or "") if role == "assistant" else ""
    return {c: (n, hashlib.sha256(a).hexdigest(), len(b), hashlib.sha256(b.encode()).hexdigest()) for c, (n, a, b) in out.items()}


def test_conversations_against_brute_force(spark):
    rows = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (2, 0, None, None), (2, 1, "assistant", ""), (2, 1, "assistant", "ü" * 50_000), (None, 3, "user", "x"), (4, None, "user", "first"), (4, 0, "user", "second"), (5, 0, "assistant", "a"), (5, 0, "assistant", "a")]
    rows += [(7, k, "user" if k % 2 else "assistant", f"turn {k} <s>") for k in range(25_000)]
    turns = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    shuffled = turns.orderBy("text")
    got = {x.conv_id: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for x in cf.digests(cf.format_turns(shuffled)).collect()}
    ordered = sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
    assert got == brute([(c, role, text) for c, _, role, text in ordered])
    assert cf.digests(cf.format_turns(turns.limit(0))).collect() == []


def test_typed_parts(spark):
    parts = [{"type": "text", "text": "see [IM"}, {"type": "text", "text": "AGE]: "}, {"type": "image", "ref": "a.png", "width": 28, "height": 15}, {"type": "audio", "ref": "b.wav", "seconds": 1.0}, {"type": "document", "ref": "c.pdf", "pages": 1}, {"type": "odd", "text": "<s>"}, None]
    turns = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [{"type": "text", "text": "fine"}]), (1, 2, "user", [{"type": "image", "ref": "d.png"}]), (2, 0, "user", None)], f"conv_id long, turn long, role string, content array<struct<{', '.join(x.replace(' ', ':') for x in cf.PART.split(', '))}>>")
    got = {(x.conv_id, x.position): x for x in cf.format_turns(turns, "content", page=3).collect()}
    first = got[1, 0]
    assert first.segment == "<s>[ROLE]user[/ROLE][INST]see [\\IMAGE]: " + "[IMAGE]" * 4 + "[AUDIO]" * 13 + "[DOCUMENT]" * 3 + "<\\s>[/INST]"
    assert [(a.kind, a.ref, a.position, a.tokens) for a in first.attachments] == [("image", "a.png", 0, 4), ("audio", "b.wav", 1, 13), ("document", "c.pdf", 2, 3)]
    assert first.expanded_tokens == 20 and got[1, 2].attachments[0].position == 3
    assert got[1, 1].segment[got[1, 1].loss_start : got[1, 1].loss_end] == "fine"
    assert got[2, 0].segment == "<s>[ROLE]user[/ROLE][INST][/INST]"


def test_a_missing_content_column_is_an_error(spark):
    with pytest.raises(Exception, match="nothing"):
        cf.format_turns(spark.createDataFrame([(1, 0, "user")], "conv_id long, turn long, role string"), "nothing")
