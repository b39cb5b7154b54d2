"""Media in long bytes: time grows with the data, whatever stands in it; media inside texts of a whole table."""

import gzip
import io
import time
import wave
import zipfile

import pytest
from pyspark.sql import functions as F

from sparkdetect.llm import media

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("piece", [b"%PDF-1", b"PK\x03\x04", b"\x1f\x8b\x08", b"GIF89a", b"OggS" + bytes(23), b"\0\0\0\x08ftyp", b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff\xe0\0\2", b"RIFF\xff\xff\0\0WAVE", b"PK\x05\x06" + bytes(18), b"GIF89a;,\0\0\0\0\0\0\0\0\0\1\1\1"])
def test_false_starts_take_linear_time(piece):
    began = time.perf_counter()
    media.sniff(piece * (4_000_000 // len(piece)))
    assert time.perf_counter() - began < 25


def archive():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello " * 50)
        z.writestr("b.txt", "x")
    return out.getvalue()


def test_ends_are_those_of_their_own_medium():
    pdf, z, g = b"%PDF-1.4 body startxref 9 %%EOF", archive(), gzip.compress(b"abc" * 99)
    data = b"%PDF-x " + pdf + b"PK\x03\x04 false " + z + g + b"\x1f\x8b\x08\x1ffalse" + z[:-1]
    found = media.sniff(data)
    assert ("application/pdf", 7, len(pdf)) in found and ("application/gzip", data.index(g), len(g)) in found
    assert [f for f in found if f[0] == "application/zip"] == [("application/zip", data.index(z), len(z))]
    assert not any(f[0] == "application/gzip" for f in media.sniff(g[:-5] + b"!" + g[-4:]))  # the checksum is compared
    named = io.BytesIO()
    with gzip.GzipFile("name.txt", "wb", fileobj=named) as f:
        f.write(b"data")
    assert media.sniff(named.getvalue())[0] == ("application/gzip", 0, len(named.getvalue()))


def test_media_inside_all_texts(spark):
    """Each document's text with a medium behind it, stored, found again at its place and read back."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    gif = "GIF89a" + "\x01\0\x01\0\0\0\0" + ";"  # ASCII alone, so that it is the same as a text
    rows = media.sniffed(media.stored_as_samples(docs.withColumn("text", F.concat("text", F.lit(gif))))).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(text)
    for r in rows:
        with wave.open(io.BytesIO(bytes(r.media))) as w:
            back = w.readframes(w.getnframes())
        raw = text[r.doc_id].encode()
        assert back.startswith(raw + gif.encode()) and r.detected == "audio/wav" and r.corrected
        assert ("image/gif", 44 + len(raw), len(gif)) in [(e.kind, e.start, e.length) for e in r.embedded]
