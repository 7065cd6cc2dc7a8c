"""Compressed streams in the secret scan: bounded memory, linear time, same results
however the stream is cut."""

import base64
import gzip
import random
import subprocess
import sys
import textwrap
import time
import zlib

import pytest

from tidemark.llm import secrets

KEY = b"password = hunter22x"


def b64(raw: bytes) -> str:
    return base64.b64encode(raw).decode()


def spans(text: str) -> str:
    return secrets.joined(secrets.secrets(text)[1])


def planted(r, depth: int) -> bytes:
    """A key below a random nesting."""
    inner = b"token=" + bytes(r.choice(b"abcdefghij0123456789") for _ in range(12))
    for _ in range(depth):
        entities = lambda t: b"".join(b"&#%d;" % c for c in t) if t.isascii() else base64.b64encode(t)
        wrap = r.choice([base64.b64encode, base64.encodebytes, gzip.compress, zlib.compress, lambda t: b"".join(b"%%%02x" % c for c in t), entities])
        inner = wrap(inner)
        if inner[:2] not in (b"\x1f\x8b", b"x\x9c"):
            inner = r.choice([b"", b"see ", b"a b\n", b"\xff\x00 "]) + inner + r.choice([b"", b" end", b"\n"])
    return inner


@pytest.mark.parametrize("seed", range(40))
def test_chunks_do_not_matter(monkeypatch, seed):
    r = random.Random(seed)
    raw = gzip.compress(planted(r, r.randrange(0, 4)))
    got = []
    for chunk, piece in ((1 << 16, 1 << 20), (7, 1 << 20), (64, 256)):
        monkeypatch.setattr(secrets, "CHUNK_BYTES", chunk)
        monkeypatch.setattr(secrets, "PIECE_BYTES", piece)
        got.append(secrets.kinds_inside(raw, 0)[0])
    # Raw bytes of an inner layer may look like more, never like less.
    assert all(0 in kinds for kinds in got)


def test_undecided_matches_at_every_cut():
    for body in (b"token:token:token:abcdef x", b"secret: token:abcdefgh", b"token   =   abcdef", b"token=abcde", b"AKIA" + b"A" * 16, b"AKIA" + b"A" * 15, b"0f" * 12, b"0f" * 11 + b"0"):
        whole = {kind for _, kind, _ in secrets.scan(body.decode())}
        for at in range(len(body)):
            for then in range(at, len(body)):
                found = secrets.Found()
                layer = secrets.Layer(found)
                for part in (b"... ", body[:at], body[at:then], body[then:], b" ..."):
                    layer.feed(part)
                layer.close()
                assert found.kinds == whole, (body, at, then)


def test_members_padding_and_unsound_streams():
    for raw in (
        gzip.compress(b"none, ") + gzip.compress(KEY), gzip.compress(KEY) + b"\0" * 40, gzip.compress(b"none") + b"\0" * 40 + gzip.compress(KEY),
        gzip.compress(KEY * 50)[:-9], gzip.compress(b"none") + b" and " + KEY, b"some bytes " + gzip.compress(gzip.compress(KEY)),
    ):
        assert "assign" in spans(f"( {b64(raw)} )"), raw
    assert spans(b64(gzip.compress(b"nothing to see"))) == ""
    deep = KEY
    for _ in range(1_500):
        deep = gzip.compress(deep)
    assert spans(b64(deep)).startswith("assign:0:")


def test_trailing_bytes_at_every_level_cost_no_more():
    raw = KEY[:-8]
    for _ in range(40):
        raw = gzip.compress(raw) + b"x"
    start = time.perf_counter()
    secrets.secrets(b64(raw))
    assert time.perf_counter() - start < 5


def test_marks_are_linear():
    def seconds(n):
        text = b64(b"\x1f\x8b\x08\x00" * n)
        start = time.perf_counter()
        secrets.secrets(text)
        return time.perf_counter() - start

    one, four = seconds(8_000), seconds(32_000)
    assert one < 2 and four < 1 + 8 * one


@pytest.mark.parametrize("unit", ["b'\\0'", "b'a'", "b'a line of words\\n'", "b'%41'", "b'YWJj\\n'"])
def test_large_streams_take_little_memory(unit):
    """A child process, so that its peak is its own: 24 MB unfold under 60 MB more."""
    code = textwrap.dedent(f"""
        import base64, gzip, io, resource
        from tidemark.llm import secrets
        unit = {unit} * (1 << 16)
        buffer = io.BytesIO()
        with gzip.GzipFile(fileobj=buffer, mode="wb", compresslevel=1) as f:
            for _ in range((24 << 20) // len(unit)):
                f.write(unit)
            f.write(b" token=abcdef123456 ")
        text = base64.b64encode(buffer.getvalue()).decode()
        before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        got = secrets.secrets(text)[1]
        after = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        assert any(k == 0 for _, k, _ in got), got
        print((after - before) // 1024)
    """)
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=60)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) < 60
