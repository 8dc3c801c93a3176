import base64
import bz2
import gzip
import hashlib
import lzma
import zlib
from urllib.parse import quote

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from omicspark.llm import secret_scan
from omicspark.llm.queries import op2_secret_scan

SECRET = "password = hunter2hunter2"
b64 = lambda x: base64.b64encode(x if isinstance(x, bytes) else x.encode()).decode()


def spans(text):
    return [(r["kind"], r["start"], r["end"], r["path"]) for r in secret_scan.findings_of(text)[0]]


@settings(max_examples=200, deadline=None)
@given(
    st.lists(
        st.sampled_from(["token", "Secret", "api_key", "APIKEY", "=", ": ", '"', "'", "abcdefgh", "AKIA", "0123456789ABCDEF", "deadbeef" * 4, "é", " ", "\n", "ſecret", "K", "passwd", "/", "x"]),
        max_size=30,
    )
)
def test_base_spans_equal_the_plain_rules(parts):
    text = "".join(parts)
    rows, _ = secret_scan.findings_of(text)
    assert [(r["kind"], r["start"], r["end"]) for r in rows if r["base"]] == brute.secret_spans(text)


PACKED = {
    "gzip": lambda x: gzip.compress(x.encode()),
    "zlib": lambda x: zlib.compress(x.encode()),
    "bz2": lambda x: bz2.compress(x.encode()),
    "xz": lambda x: lzma.compress(x.encode()),
    "zstd": lambda x: zstandard.ZstdCompressor().compress(x.encode()),
}


@pytest.mark.parametrize("pack", PACKED)
def test_compressed_layers(pack):
    coded = b64(PACKED[pack](f"first line\n{SECRET}\n"))
    assert spans(f"é {coded} end") == [("assign", 2, 2 + len(coded), "/base64/compressed")]


RAW = {
    "gzip": gzip.compress, "zlib": zlib.compress, "bz2": bz2.compress, "xz": lzma.compress,
    "zstd": zstandard.ZstdCompressor().compress,
}


def as_repr(data):
    return repr(data)[2:-1]


@pytest.mark.parametrize("outer", PACKED)
@pytest.mark.parametrize("inner", PACKED)
def test_compressed_data_inside_compressed_data(inner, outer):
    coded = b64(RAW[outer](RAW[inner]((noise(900) + SECRET).encode()) + b" end"))
    assert [(k, p) for k, _, _, p in spans(coded)] == [("assign", "/base64/compressed/compressed")]
    assert secret_scan.redact_text(f"see {coded} end") == "see [assign] end"


@pytest.mark.parametrize("write", [quote, as_repr, lambda x: "".join(f"%{b:02x}" for b in x), lambda x: "".join(f"\\x{b:02x}" for b in x)])
def test_compressed_data_in_escapes(write):
    for pack in PACKED.values():
        text = write(pack(noise(900) + SECRET))
        assert "assign" in {k for k, _, _, p in spans(f"see {text}") if p.endswith("/compressed")}


@pytest.mark.parametrize("coding", ["utf-16", "utf-16-le", "utf-16-be", "utf-32"])
def test_wide_characters(coding):
    data = f"A dull line. {SECRET}".encode(coding)
    assert [k for k, *_ in spans(b64(data))] == ["assign"] == [k for k, *_ in spans(b64(gzip.compress(data)))]


def test_what_follows_a_bomb_is_read():
    bomb = zlib.compress(b"a" * 10_000_000)
    rows, unopened = secret_scan.findings_of(b64(bomb + b"??" + gzip.compress(SECRET.encode())), max_layer=1 << 20)
    assert [r["kind"] for r in rows] == ["assign"] and unopened == 1


def test_long_compressed_data_inside_others(monkeypatch):
    monkeypatch.setattr(secret_scan, "PIECE_BYTES", 1 << 14)
    monkeypatch.setattr(secret_scan, "OVERLAP_BYTES", 1 << 10)
    data = (noise(200_000) + SECRET + noise(100_000) + " pass").encode()
    for pack in (gzip.compress, bz2.compress, lzma.compress, zstandard.ZstdCompressor().compress):
        inner = pack(data) + pack(b"word = " + b"x" * 12)
        found = spans(b64(gzip.compress(b"- " * 5_000 + pack(b"? " * 900 + inner + b"!" * 99_999))))
        assert {k for k, *_ in found} == {"assign"} and found[0][3] == "/base64/compressed/compressed/compressed"


def test_deep_compression_ends():
    data = SECRET.encode()
    for _ in range(400):
        data = zlib.compress(data)
    assert [k for k, *_ in spans(b64(data))] == ["assign"]


def test_span_of_base64_covers_the_secret_only():
    coded = b64("A" * 30 + " " + SECRET)
    ((kind, start, end, path),) = spans("é" + coded)
    assert (kind, path) == ("assign", "/base64") and 1 + 40 <= start <= 1 + 42 and end == 1 + len(coded.rstrip("="))


def test_nested_layers_to_the_end():
    text = SECRET
    for _ in range(4):
        text = b64(gzip.compress(quote(b64(text)).encode()))
    ((kind, start, end, path),) = spans(f"see {text}.")
    assert (kind, start, end) == ("assign", 4, 4 + len(text))
    assert path == "/base64/compressed/base64" * 4


@pytest.mark.parametrize(
    "text",
    [
        "password%20%3D%20hunter2hunter2", "%70assword = hunter2hunter2", chr(92) + "u0070assword = hunter2hunter2",
        r"\x70assword = hunter2hunter2", r"\u{70}assword = hunter2hunter2", "&#112;assword = hunter2hunter2",
        "&#x70;assword = hunter2hunter2", r"\U00000070assword = hunter2hunter2", "%2570assword = hunter2hunter2",
    ],
)
def test_escapes(text):
    found = spans("go " + text + " on")
    assert [f[:3] for f in found] == [("assign", 3, 3 + len(text))] and found[0][3]


def test_bytes_that_are_no_text_stay():
    assert spans("100%ff%fe \\ud800 &#xd800; &#9999999; " + b64(bytes(range(128, 200)))) == []


def test_open_secret_is_reported_once_beside_escapes():
    text = f"%41 {SECRET} &#65;"
    assert [f[0] for f in spans(text)] == ["assign"] and spans(text)[0][3] == ""


def test_cycle_ends(monkeypatch):
    monkeypatch.setattr(secret_scan, "_percent", lambda m: "%41")
    assert spans(f"%41 {SECRET}") == [("assign", 4, 4 + len(SECRET), "")]


def test_bomb_is_not_opened():
    rows, unopened = secret_scan.findings_of(b64(zlib.compress(b"a" * 10_000_000)), max_layer=1 << 20)
    assert rows == [] and unopened == 1


def noise(size):
    """Text that hardly compresses, so that payloads are long."""
    return "".join(hashlib.sha256(str(i).encode()).hexdigest().upper() for i in range(size // 64 + 1))[:size]


def wrapped(coded, width, end="\n"):
    return end.join(coded[i : i + width] for i in range(0, len(coded), width))


@pytest.mark.parametrize("pack", PACKED)
@pytest.mark.parametrize("glue", ["", "a", "ab", "abc", "/some/path-with_both-"])
@pytest.mark.parametrize(
    "form",
    [
        lambda x: x, lambda x: x.translate(str.maketrans("+/", "-_")).rstrip("="), lambda x: wrapped(x, 64),
        lambda x: wrapped(x, 76, "\r\n"), lambda x: wrapped(x, 16), lambda x: wrapped(x, 64, "\n    "),
    ],
)
def test_glued_wrapped_and_urlsafe_payloads(pack, glue, form):
    coded = b64(PACKED[pack](f"{noise(900)} {SECRET}\n"))
    text = f"é {glue}{form(coded)}"
    found = spans(text + " end")
    assert [(k, p) for k, _, _, p in found] == [("assign", "/base64/compressed")]
    assert found[0][1] <= 2 + len(glue) and found[0][2] == len(text)


@pytest.mark.parametrize("phase", range(4))
@pytest.mark.parametrize("width", [20, 64, 500])
def test_plain_base64_from_any_place(phase, width):
    text = "x" * phase + wrapped(b64("A" * 90 + "\u00e9 " + SECRET).rstrip("="), width)
    ((kind, start, end, path),) = spans(text)
    assert (kind, path) == ("assign", "/base64") and start > phase + 90 * 8 // 6 and end == len(text)


@pytest.mark.parametrize("pack", PACKED)
def test_members_and_payloads_side_by_side(pack):
    members = PACKED[pack](noise(90) + " pass") + PACKED[pack]("word = hunter2hunter2")
    assert [s[0] for s in spans(b64(members))] == ["assign"]
    one, two = (PACKED[pack](f"{' ' * i}{x}") for i, x in ((1, SECRET), (2, "AKIA" + "Z" * 16)))
    assert {s[0] for s in spans(b64(one + b"??" + two))} == {"assign", "access"}
    after = f"{b64(PACKED[pack](SECRET)).rstrip('=')}\nplainword"
    assert {s[0] for s in spans(after)} == {"assign"}


@pytest.mark.parametrize("odd", ["\u00a0", "\u3000", "\ufeff", "\u200b", "\u00ad", "\x00", "\x1b", b"\xff"])
def test_odd_characters_hide_nothing(odd):
    odd = odd if isinstance(odd, bytes) else odd.encode()
    data = odd + b" " + SECRET.encode()
    quoted = "".join(f"%{b:02x}" for b in data)
    for text in (b64(data), b64(gzip.compress(data)), quoted):
        assert [s[0] for s in spans(text)] == ["assign"], text
    assert [s[0] for s in spans("\\ud800" + "".join(f"\\u{ord(c):04x}" for c in SECRET))] == ["assign"]


def test_long_layers_are_read_to_the_end(monkeypatch):
    monkeypatch.setattr(secret_scan, "PIECE_BYTES", 1 << 14)
    monkeypatch.setattr(secret_scan, "OVERLAP_BYTES", 1 << 10)
    inner = b64(gzip.compress((noise(40_000) + SECRET).encode()))
    for text in ("a b " * 20_000 + SECRET, "a b " * 20_000 + inner, " " * ((1 << 14) - 9) + SECRET + " b" * 9_000):
        assert [s[0] for s in spans(b64(gzip.compress(text.encode())))] == ["assign"]
    assert [s[0] for s in spans(b64(zlib.compress(b"ab " * 12_000_000 + SECRET.encode())))] == ["assign"]


def test_redaction_replaces_what_was_not_opened():
    coded = b64(zlib.compress(b"a " * 5_000_000 + SECRET.encode()))
    assert secret_scan.redact_text(f"see {coded} end", max_layer=1 << 20) == "see [unopened] end"
    assert secret_scan.redact_text(f"see {coded} end") == "see [assign] end"


def test_redacted_text_holds_no_secret():
    text = f"a {SECRET} b {b64('x ' + SECRET)} c AKIA{'A' * 16} d token=token=abcdefgh e"
    clean = secret_scan.redact_text(text)
    assert clean.startswith("a [assign] b ") and clean.endswith("c [access] d [assign] e")
    assert secret_scan.findings_of(clean) == ([], 0)
    assert secret_scan.redact_text(None) is None and secret_scan.redact_text("") == ""


def test_query_over_odd_rows(spark, tmp_path):
    texts = [None, "", "x" * 300_000 + " " + SECRET, SECRET, SECRET, f"{SECRET} {b64('AKIA' + 'Z' * 20)}"]
    rows = [(i if i != 4 else 3, t, "x") for i, t in enumerate(texts)] + [(None, SECRET, None)]
    spark.createDataFrame(rows, "doc_id long, text string, findings string").write.parquet(f"{tmp_path}/documents.parquet")
    found = op2_secret_scan(spark, str(tmp_path)).collect()
    assert len(found) == 7
    for r in found:
        text = texts[r.doc_id] if r.doc_id is not None else SECRET
        want = brute.secret_spans(text or "")
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in want) for k in secret_scan.KINDS)
        assert r.base_sha256 == brute.digest(want)
    assert next(r.spans for r in found if r.doc_id == 5).endswith(",access:26:58")


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert secret_scan.scan(docs).collect() == []


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert all(r.base_sha256 == brute.digest(brute.secret_spans(texts[r.doc_id])) for r in op2_secret_scan(spark, folder).collect())
