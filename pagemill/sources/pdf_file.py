"""A small PDF reader and writer in plain Python, for where no extractor is installed.

It reads what simple writers write: plain and Flate-coded streams, object
streams, page trees, text operators, fonts with a map to Unicode, and
bookmarks. Layout, encryption and other codings are left to the extractors;
an encrypted or broken file raises.
"""

from __future__ import annotations

import re
import zlib

TOKEN = re.compile(rb"\s*(?:%[^\r\n]*\s*)*(<<|>>|\[|\]|\(|<[0-9A-Fa-f\s]*>|/[^\s()<>\[\]{}/%]*|[+-]?\d*\.?\d+|[^\s()<>\[\]{}/%]+)")
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    """A PDF name, without its slash."""


class Ref(int):
    """A reference to an object by its number."""


class Operator(str):
    """A keyword of a content stream."""


def literal(data: bytes, at: int) -> tuple[bytes, int]:
    """A string in parentheses that begins before `at`, and where it ends."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        if c == b"\\":
            n = data[at + 1 : at + 2]
            octal = re.match(rb"[0-7]{1,3}", data[at + 1 : at + 4])
            if octal:
                out.append(int(octal[0], 8) & 255)
                at += 1 + len(octal[0])
                continue
            out += ESCAPES.get(n, b"" if n in b"\r\n" else n)
            at += 2
            continue
        depth += (c == b"(") - (c == b")")
        at += 1
        if not depth:
            break
        out += c
    return bytes(out), at


def parsed(data: bytes) -> list:
    """The values of a body: numbers, bytes, names, references, lists, dicts, operators."""
    stack: list[list] = [[]]
    at = 0
    while m := TOKEN.match(data, at):
        token, at = m[1], m.end()
        top = stack[-1]
        if token in (b"<<", b"["):
            stack.append([])
        elif token in (b">>", b"]") and len(stack) > 1:
            done = stack.pop()
            stack[-1].append(dict(zip(done[::2], done[1::2], strict=False)) if token == b">>" else done)
        elif token == b"(":
            text, at = literal(data, at)
            top.append(text)
        elif token[:1] == b"<" and token[-1:] == b">":
            digits = re.sub(rb"\s", b"", token[1:-1]).decode()
            top.append(bytes.fromhex(digits + "0" * (len(digits) % 2)))
        elif token[:1] == b"/":
            top.append(Name(token[1:].decode("latin-1")))
        elif token == b"R" and len(top) >= 2 and isinstance(top[-2], int):
            top[-2:] = [Ref(top[-2])]
        elif re.fullmatch(rb"[+-]?\d+", token):
            top.append(int(token))
        elif re.fullmatch(rb"[+-]?\d*\.\d+", token):
            top.append(float(token))
        else:
            top.append({b"true": True, b"false": False, b"null": None}.get(token, Operator(token.decode("latin-1"))))
    return stack[0]


class PdfFile:
    """The objects of a file by number; an object's last definition counts."""

    def __init__(self, data: bytes) -> None:
        if not data.lstrip()[:5] == b"%PDF-":
            raise ValueError("not a PDF")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise ValueError("encrypted")
        self.objects: dict[int, object] = {}
        self.streams: dict[int, bytes] = {}
        at = 0
        begin = re.compile(rb"(\d+)\s+\d+\s+obj\b")
        while m := begin.search(data, at):
            number, end, stream = int(m[1]), data.find(b"endobj", m.end()), data.find(b"stream", m.end())
            end = len(data) if end < 0 else end
            if 0 <= stream < end:
                first = stream + 6 + (2 if data[stream + 6 : stream + 8] == b"\r\n" else 1)
                last = data.find(b"endstream", first)
                last = len(data) if last < 0 else last
                self.streams[number] = data[first:last]
                at = last
            else:
                stream, at = end, end
            body = parsed(data[m.end() : stream])
            self.objects[number] = body[0] if body else None
        for number in [n for n, o in self.objects.items() if isinstance(o, dict) and o.get("Type") == "ObjStm"]:
            self._unpack(number)
        self.root = next((o for o in self.objects.values() if isinstance(o, dict) and o.get("Type") == "Catalog"), None)
        if self.root is None:
            raise ValueError("no catalog")

    def _unpack(self, number: int) -> None:
        head, data = self.objects[number], self.decoded(number)
        first = self.get(head["First"])
        at = [int(x) for x in data[:first].split()]
        places = list(zip(at[::2], at[1::2], strict=False))
        for i, (inner, begin) in enumerate(places):
            end = places[i + 1][1] if i + 1 < len(places) else len(data) - first
            body = parsed(data[first + begin : first + end])
            self.objects.setdefault(inner, body[0] if body else None)

    def get(self, value):
        """The value, or the object that it refers to."""
        for _ in range(32):
            if not isinstance(value, Ref):
                return value
            value = self.objects.get(int(value))
        return None

    def decoded(self, number: int) -> bytes:
        filters = self.get(self.objects[number].get("Filter")) if isinstance(self.objects[number], dict) else None
        data = self.streams.get(number, b"")
        for name in filters if isinstance(filters, list) else [filters] if filters else []:
            if name == "FlateDecode":
                data = zlib.decompressobj().decompress(data)
            elif name == "ASCIIHexDecode":
                data = bytes.fromhex(re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0]).decode())
            else:
                raise ValueError(f"coding {name}")
        return data

    def pages(self) -> list[dict]:
        """The pages in order; what they inherit is theirs."""
        out, stack, seen = [], [(self.root.get("Pages"), {})], set()
        while stack:
            ref, above = stack.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or (isinstance(ref, Ref) and int(ref) in seen):
                continue
            if isinstance(ref, Ref):
                seen.add(int(ref))
            mine = {**above, **({"Resources": node["Resources"]} if "Resources" in node else {})}
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                stack += [(k, mine) for k in reversed(kids)]
            else:
                out.append({**mine, **node})
        return out

    def to_unicode(self, font) -> dict[bytes, str] | None:
        """The font's map from codes to text, if it has one."""
        ref = (self.get(font) or {}).get("ToUnicode")
        if not isinstance(ref, Ref):
            return None
        out, last = {}, []
        for v in parsed(self.decoded(int(ref))):
            if not isinstance(v, Operator):
                last.append(v)
                continue
            if v == "endbfchar":
                out |= {a: b.decode("utf-16-be", "replace") for a, b in zip(last[::2], last[1::2], strict=False) if isinstance(b, bytes)}
            elif v == "endbfrange":
                for a, b, c in zip(last[::3], last[1::3], last[2::3], strict=False):
                    for i in range(int.from_bytes(b, "big") - int.from_bytes(a, "big") + 1):
                        code = (int.from_bytes(a, "big") + i).to_bytes(len(a), "big")
                        to = c[i] if isinstance(c, list) else (int.from_bytes(c, "big") + i).to_bytes(len(c), "big")
                        out[code] = to.decode("utf-16-be", "replace")
            last = []
        return out

    def text(self, page: dict) -> str:
        """The text that a page shows, in the order of its operators, with a line for each move to another height."""
        contents = page.get("Contents")
        refs = self.get(contents)
        refs = refs if isinstance(refs, list) else [contents]
        data = b"\n".join(self.decoded(int(r)) for r in refs if isinstance(r, Ref))
        fonts = self.get((self.get(page.get("Resources")) or {}).get("Font")) or {}
        maps: dict[str, dict | None] = {}
        out, operands, font = [], [], None

        def show(raw: bytes) -> str:
            if font not in maps:
                maps[font] = self.to_unicode(fonts[font]) if font in fonts else None
            codes = maps[font]
            if not codes:
                return raw.decode("cp1252", "replace")
            n = len(next(iter(codes)))
            return "".join(codes.get(raw[i : i + n], "") for i in range(0, len(raw), n))

        for v in parsed(data):
            if not isinstance(v, Operator):
                operands.append(v)
                continue
            if v == "Tf" and len(operands) > 1:
                font = str(operands[-2])
            elif v in ("T*", "'", '"', "Tm", "ET") or (v in ("Td", "TD") and operands and operands[-1]):
                out.append("\n")
            elif v in ("Td", "TD"):
                out.append(" ")
            if v in ("Tj", "'", '"') and operands and isinstance(operands[-1], bytes):
                out.append(show(operands[-1]))
            elif v == "TJ" and operands and isinstance(operands[-1], list):
                out += [show(x) if isinstance(x, bytes) else " " if isinstance(x, (int, float)) and x < -200 else "" for x in operands[-1]]
            operands = []
        lines = (" ".join(x.split()) for x in "".join(out).split("\n"))
        return "\n".join(x for x in lines if x)

    def titles(self) -> list[str]:
        """Titles of the first level of bookmarks."""
        out, seen = [], set()
        ref = (self.get(self.root.get("Outlines")) or {}).get("First")
        while isinstance(ref, Ref) and int(ref) not in seen:
            seen.add(int(ref))
            item = self.get(ref) or {}
            raw = self.get(item.get("Title"))
            if isinstance(raw, bytes):
                out.append(raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace"))
            ref = item.get("Next")
        return out


def written(pages: list[str], titles: list[str] = (), compress: bool = False) -> bytes:
    """A PDF with a page for each text, line by line, and a bookmark for each title."""
    quoted = lambda s: b"(" + re.sub(rb"([\\()])", rb"\\\1", s.encode("cp1252", "replace")) + b")"
    n, outline = len(pages), 4 + 2 * len(pages)
    kids = " ".join(f"{4 + 2 * i} 0 R" for i in range(n))
    bodies: list[bytes] = [
        b"<< /Type /Catalog /Pages 2 0 R" + (f" /Outlines {outline} 0 R".encode() if titles else b"") + b" >>",
        f"<< /Type /Pages /Kids [{kids}] /Count {n} >>".encode(),
        b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>",
    ]
    for i, text in enumerate(pages):
        shown = b"BT /F1 11 Tf 50 780 Td 14 TL\n" + b"\n".join(quoted(line) + b" Tj T*" for line in text.split("\n")) + b"\nET"
        data, coding = (zlib.compress(shown), b" /Filter /FlateDecode") if compress else (shown, b"")
        bodies.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * i} 0 R >>".encode())
        bodies.append(b"<< /Length " + str(len(data)).encode() + coding + b" >>\nstream\n" + data + b"\nendstream")
    if titles:
        bodies.append(f"<< /Type /Outlines /First {outline + 1} 0 R /Last {outline + len(titles)} 0 R /Count {len(titles)} >>".encode())
        for i, title in enumerate(titles):
            more = f" /Next {outline + 2 + i} 0 R".encode() if i + 1 < len(titles) else b""
            bodies.append(b"<< /Title " + quoted(title) + f" /Parent {outline} 0 R".encode() + more + b" >>")
    out, places = bytearray(b"%PDF-1.4\n"), []
    for number, body in enumerate(bodies, start=1):
        places.append(len(out))
        out += f"{number} 0 obj\n".encode() + body + b"\nendobj\n"
    start = len(out)
    out += f"xref\n0 {len(bodies) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{p:010d} 00000 n \n".encode() for p in places)
    return bytes(out + f"trailer\n<< /Size {len(bodies) + 1} /Root 1 0 R >>\nstartxref\n{start}\n%%EOF\n".encode())
