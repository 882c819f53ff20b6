"""The reader on archives as others write them, and on damaged ones."""

from __future__ import annotations

import io

import pytest
import zstandard

from ravine.llm import warc


def archive(*bodies, dictionary=b"", streamed=False):
    out = [warc.skippable(dictionary)] if dictionary else []
    packer = zstandard.ZstdCompressor(3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    for body in bodies:
        if streamed:
            sink = io.BytesIO()
            with packer.stream_writer(sink, closefd=False) as w:
                w.write(body)
            out.append(sink.getvalue())
        else:
            out.append(packer.compress(body))
    return b"".join(out)


ONE, EMPTY = warc.record(1, "http://a/", b"<p>one</p>" * 50, None, False), warc.record(None, None, b"", None, False)
AGAIN = warc.record(2, "http://b/", b"<p>one</p>" * 50, 1, True)


@pytest.mark.parametrize("dictionary", [b"", warc.train([ONE, EMPTY, AGAIN])])
def test_streamed_frames(dictionary):
    whole, streamed = (list(warc.records(archive(ONE, EMPTY, AGAIN, dictionary=dictionary, streamed=s))) for s in (False, True))
    assert whole == streamed and [h["warc-type"] for h, _ in whole] == ["response", "response", "revisit"]
    assert [p for _, p in whole] == [b"<p>one</p>" * 50, b"", b""]


@pytest.mark.parametrize(
    "before, after",
    [
        (b"X-Payload-Length: 500", b"X-Payload-Length: 501"),
        (b"X-Payload-Length: 500", b"X-Payload-Length: -5"),
        (b"X-Payload-Length: 500", b"X-Payload-Length: many"),
        (b"WARC-Payload-Digest: sha1:", b"WARC-Payload-Digest: sha1:0"),
        (b"WARC-Payload-Digest: ", b"X-Other: "),
        (b"WARC-Type: ", b"WARC-Kind: "),
        (b"WARC-Record-ID", b"\xff\xfe"),
        (b"WARC/1.", b"WARC/2."),
    ],
)
@pytest.mark.parametrize("body", [ONE, AGAIN])
def test_damaged_records(body, before, after):
    assert before in body
    with pytest.raises(warc.WarcError):
        list(warc.records(archive(body.replace(before, after))))


def test_damaged_frames():
    good = archive(ONE, EMPTY, dictionary=warc.train([ONE, EMPTY]), streamed=True)
    for bad in (good[:-3], good[:3], good + b"xyz", good + b"12345678", archive(ONE)[:-1], good[: len(good) // 2]):
        with pytest.raises(warc.WarcError):
            list(warc.records(bad))
    frame = bytearray(archive(ONE))
    frame[len(frame) // 2 : len(frame) // 2 + 8] = b"\xff" * 8
    with pytest.raises(warc.WarcError):
        list(warc.records(bytes(frame)))
