"""Archives and conversations: round trips, defined results for awkward rows, brute force."""

import base64
import hashlib

import pytest

from trialloom.llm import arc, chat


def test_headers_of_both_versions_and_damage():
    for version in (1, 2):
        name = "a.arc"
        data = arc.version_block(name, version, "20240101000000") + b"".join(
            arc.arc_record(version, i, u, h, "20240102030405", name, 0)
            for i, u, h in [(1, "http://x/a b", "<p>é\r\n\r\n</p>"), (None, None, None), (3, "http://y", "WARC/1.1\n")])
        found = list(arc.read_arc(data))
        assert [r.version for r in found] == [version] * 3
        assert [r.fields["url"] for r in found] == ["http://x/a%20b", "-", "http://y"]
        assert [r.payload() for r in found] == ["<p>é\r\n\r\n</p>".encode(), b"", b"WARC/1.1\n"]
        assert [r.http("x-page-id") for r in found] == ["1", "-", "3"]
        warc = b"".join(arc.warc_record(r, name, k) + b"\r\n\r\n" for k, r in enumerate(found))
        heads = [h for h, _ in arc.read_warc(warc)]
        assert heads[0]["WARC-Date"] == "2024-01-02T03:04:05Z"
        assert heads[0]["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(
            hashlib.sha1("<p>é\r\n\r\n</p>".encode()).digest()).decode()
        assert len({h["WARC-Record-ID"] for h in heads}) == 3
        with pytest.raises(ValueError):
            list(arc.read_arc(data[:-20]))
        with pytest.raises(ValueError):
            list(arc.read_warc(warc[:-10]))
    assert arc.warc_date("199705") == "1997-05-01T00:00:00Z" and arc.warc_date("x") == "1970-01-01T00:00:00Z"
    plain = arc.ArcRecord(1, {"url": "u", "ip": "i", "date": "2000", "type": "text/plain"}, b"no http")
    assert b"Content-Type: text/plain" in arc.warc_record(plain, "a", 0)


def test_pages_come_back(spark):
    rows = [(5, "http://a", "same"), (3, "http://b", "same"), (9, None, None), (8, "http://c", ""), (None, "http://d", "x"),
            (4, "http://e", "x"), (None, "http://f", "alone"), (2, "http://a", "é" * 50_000), (2, "http://a", "é" * 50_000)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload_bytes string")
    for limit in (1 << 20, 100):
        got = sorted(tuple(r) for r in arc.archive_pages(pages, limit=limit).select(
            "record_type", "payload_bytes", "payload_digest", "page_id", "refers_to").fillna(-1).collect())
        first = {}
        for i, _, h in rows:
            if i is not None and (h or "") not in first or i is not None and i < first[h or ""]:
                first[h or ""] = i
        want, used = [], set()
        for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
            body = (h or "").encode()
            again = (h or "") in used
            used.add(h or "")
            want.append(("revisit" if again else "response", len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
                         -1 if i is None else i, first.get(h or "", -1) if again else -1))
        assert got == sorted(want)
    assert arc.archive_pages(pages.where("false")).count() == 0


def brute_pairs(turns):
    """Prompt and completions of each pair, in plain Python."""
    out = {}
    for pair in {t[0] for t in turns}:
        sides = {s: sorted((t[2] if t[2] is not None else -1, t[3] or "unknown", t[4] or "") for t in turns
                           if t[0] == pair and t[1] == s) for s in ("chosen", "rejected")}
        numbers = sorted({t[0] for own in sides.values() for t in own})
        split = next((n for n in numbers if [t for t in sides["chosen"] if t[0] == n]
                      != [t for t in sides["rejected"] if t[0] == n]), None)
        parts = {"prompt": [t for t in sides["chosen"] if split is None or t[0] < split]}
        parts |= {s: [t for t in own if split is not None and t[0] >= split] for s, own in sides.items()}
        out[pair] = {k: "".join(f"<|{r}|>\n{x}<|end|>\n" for _, r, x in v) for k, v in parts.items() if v}
    return out


def test_pairs_equal_brute_force(spark):
    turns = [(1, "chosen", 0, "user", "hi"), (1, "rejected", 0, "user", "hi"), (1, "chosen", 1, "assistant", "a"),
             (1, "rejected", 1, "assistant", "b"), (1, "chosen", 2, "user", "hi"), (1, "rejected", 2, "user", "hi"),
             (2, "chosen", 0, "user", "x"), (2, "rejected", 0, "user", "x"),
             (3, "chosen", 0, "user", "only"), (4, "rejected", None, None, None),
             (5, "chosen", 1, "user", "t"), (5, "chosen", 1, "user", "t"), (5, "rejected", 1, "user", "t"),
             (6, "chosen", 1, "user", "t"), (6, "chosen", 1, "user", "s"), (6, "rejected", 1, "user", "s"),
             (6, "rejected", 1, "user", "t"), (6, "chosen", 2, "assistant", "é" * 20_000),
             (None, "chosen", 0, "user", "n"), (None, "rejected", 0, "user", "n"), (None, "chosen", 1, "assistant", "m")]
    turns += [(7, s, k, "assistant" if k % 2 else "user", f"t{k}" if k < 150 or s == "chosen" else "other")
              for s in ("chosen", "rejected") for k in range(300)]
    df = spark.createDataFrame([(*t, 1) for t in turns], "pair_id long, side string, turn long, role string, text string, start int")
    got = {}
    for r in chat.format_pairs(df).collect():
        got.setdefault(r.pair_id, {}).setdefault(r.part, []).append(r)
    want = brute_pairs(turns)
    assert {p: set(v) for p, v in got.items()} == {p: set(v) for p, v in want.items()}
    for pair, parts in got.items():
        for part, rows in parts.items():
            rows.sort(key=lambda r: (r.start, r.end))
            assert "".join(r.rendered for r in rows) == want[pair][part]
            assert [r.start for r in rows] == [0, *[r.end for r in rows[:-1]]]
            assert all(r.mask == int(part != "prompt" and r.role == "assistant") for r in rows)
    assert chat.format_pairs(df.where("false")).count() == 0


def test_stale_replies(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "first"), (1, 2, "user", "r"), (1, 3, "assistant", "second"),
            (2, 0, "user", "q"), (2, 1, "assistant", "one"), (3, 0, "user", "alone"), (4, 0, "assistant", None),
            (4, 1, "assistant", "x"), (None, 0, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.stale_replies(df).collect()
    rejected = sorted(((r.pair_id, r.turn, r.text) for r in made if r.side == "rejected"), key=str)
    assert (1, 3, "first") in rejected and (2, 0, "q") in rejected and (4, 1, None) in rejected
    assert not any(p == 2 and t == 1 for p, t, _ in rejected) and (None, 0, "n") in rejected
    assert sum(r.side == "chosen" for r in made) == len(rows)
