"""Text of simple PDF files: pages in order, Flate streams, object streams, strings shown by text operators, ToUnicode maps.

No layout is worked out and nothing is decrypted; for such files give `read_pdf` another extractor.
"""

from __future__ import annotations

import re
import zlib

OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R")
TOKEN = re.compile(rb"\((?:\\.|[^\\()])*(?:\((?:\\.|[^\\()])*\)(?:\\.|[^\\()])*)*\)|<<|>>|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s\[\]()<>/]*|[^\s\[\]()<>/]+", re.S)
#: Escapes of the format's strings.
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: A shift back by more than so many thousandths of the font's size between two strings is a space.
GAP = -200


def stream_of(body: bytes) -> bytes:
    found = STREAM.search(body)
    if not found:
        return b""
    head, raw = body[: found.start()], found.group(1)
    if b"/FlateDecode" in head or b"/Fl " in head:
        try:
            return zlib.decompressobj().decompress(raw)
        except zlib.error:
            return b""
    return raw


def objects(data: bytes) -> dict[int, bytes]:
    """Bodies by number; those inside object streams too."""
    out = {int(m.group(1)): m.group(2) for m in OBJECT.finditer(data)}
    for body in list(out.values()):
        if b"/ObjStm" not in body:
            continue
        text, first = stream_of(body), re.search(rb"/First\s+(\d+)", body)
        if not first:
            continue
        begin = int(first.group(1))
        numbers = [int(x) for x in text[:begin].split()]
        places = list(zip(numbers[::2], numbers[1::2], strict=False))
        for i, (number, at) in enumerate(places):
            end = places[i + 1][1] if i + 1 < len(places) else len(text) - begin
            out.setdefault(number, text[begin + at : begin + end])
    return out


def entry(body: bytes, key: bytes) -> bytes:
    """What follows /key in a dictionary: a reference, array or dictionary, as it stands."""
    found = re.search(rb"/" + key + rb"(?![A-Za-z])\s*(\d+\s+\d+\s+R|\[.*?\]|<<.*?>>(?:\s*>>)*|/[^\s/<>\[\]]+)", body, re.S)
    return found.group(1) if found else b""


def references(value: bytes) -> list[int]:
    return [int(x) for x in REFERENCE.findall(value)]


def pages(found: dict[int, bytes]) -> list[bytes]:
    """The bodies of the pages in order, each with what it inherits."""
    catalog = next((b for b in found.values() if re.search(rb"/Type\s*/Catalog", b)), b"")
    out, seen = [], set()

    def walk(number: int, inherited: bytes) -> None:
        body = found.get(number, b"")
        if number in seen or not body:
            return
        seen.add(number)
        own = entry(body, b"Resources")
        inherited = own or inherited
        kids = entry(body, b"Kids")
        if kids:
            for k in references(kids):
                walk(k, inherited)
        else:
            out.append(body if own else body + b" /Resources " + inherited)

    for root in references(entry(catalog, b"Pages")):
        walk(root, b"")
    return out or [b for b in found.values() if re.search(rb"/Type\s*/Page(?!s)", b)]


def resolved(found: dict[int, bytes], value: bytes) -> bytes:
    return found.get(references(value)[0], b"") if re.fullmatch(rb"\s*\d+\s+\d+\s+R\s*", value) else value


def character_map(text: bytes) -> dict[int, str]:
    """Codes to texts of a ToUnicode map."""
    out: dict[int, str] = {}
    said = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", text, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            out[int(a, 16)] = said(b)
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", text, re.S):
        for a, z, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            start = said(b)
            for i in range(min(int(z, 16) - int(a, 16) + 1, 1 << 16)):
                out[int(a, 16) + i] = start[:-1] + chr(ord(start[-1]) + i)
    return out


def fonts(found: dict[int, bytes], page: bytes) -> dict[bytes, dict[int, str]]:
    """The maps of the page's fonts by name; fonts without one are left out."""
    listed = resolved(found, entry(resolved(found, entry(page, b"Resources")), b"Font"))
    out = {}
    for name, number in re.findall(rb"/([^\s/<>\[\]]+)\s+(\d+)\s+\d+\s+R", listed):
        uses = references(entry(found.get(int(number), b""), b"ToUnicode"))
        if uses:
            out[name] = character_map(stream_of(found.get(uses[0], b"")))
    return out


def unescaped(token: bytes) -> bytes:
    def one(m: re.Match) -> bytes:
        c = m.group(1)
        if c.isdigit():
            return bytes([int(c, 8) & 255])
        return b"" if c in b"\r\n" else ESCAPES.get(c, c)

    return re.sub(rb"\\([0-7]{1,3}|.)", one, token[1:-1], flags=re.S)


def shown(token: bytes, chars: dict[int, str] | None) -> str:
    raw = unescaped(token) if token.startswith(b"(") else bytes.fromhex((lambda h: h + "0" * (len(h) % 2))(re.sub(rb"\s", b"", token[1:-1]).decode()))
    if not chars:
        return raw.decode("cp1252", "replace")
    width = 2 if max(chars) > 255 or token.startswith(b"<") and len(raw) % 2 == 0 and not any(c in chars for c in raw) else 1
    return "".join(chars.get(int.from_bytes(raw[i : i + width]), "") for i in range(0, len(raw), width))


def text_of(content: bytes, maps: dict[bytes, dict[int, str]]) -> str:
    out, stack, font = [], [], None
    for token in TOKEN.findall(content):
        if token[:1] in b"(<[]/" or re.fullmatch(rb"[-+.\d]+", token):
            stack.append(token)
            continue
        if token == b"Tf":
            font = next((maps.get(t[1:]) for t in reversed(stack) if t.startswith(b"/")), None)
        elif token in (b"Tj", b"'", b'"', b"TJ"):
            if token in (b"'", b'"'):
                out.append("\n")
            for t in stack:
                if t[:1] in b"(<" and t not in (b"<<", b">>"):
                    out.append(shown(t, font))
                elif token == b"TJ" and re.fullmatch(rb"[-+.\d]+", t) and float(t) < GAP:
                    out.append(" ")
        elif token in (b"Td", b"TD", b"T*", b"Tm", b"ET") and out and out[-1] != "\n":
            out.append("\n")
        stack = []
    return "".join(out).strip("\n")


def pages_of(data: bytes) -> list[str]:
    """The text of each page, in order; empty where none can be read."""
    found = objects(data)
    out = []
    for page in pages(found):
        content = b"\n".join(stream_of(found.get(n, b"")) for n in references(entry(page, b"Contents")))
        out.append(text_of(content, fonts(found, page)))
    return out
