"""The own words of a raw e-mail message: decoded, without headers, quoted messages, signature, disclaimer, markup and attachments."""

from __future__ import annotations

import base64
import binascii
import html
import quopri
import re
import unicodedata
from collections import Counter

_HEADER = re.compile(r"^[^\W\d_][\w-]{1,40}:\s?", re.M)
_MISREAD = re.compile("[\u00c2-\u00f4][\u0080-\u00bf]")
_PARAM = re.compile(r"""(boundary|charset)\s*=\s*(?:"([^"]*)"|([^\s;]+))""", re.I)
_QUOTE_LINE = re.compile(r"^\s*(?:>|&gt;|\|\s)")
_ORIGINAL = re.compile(r"^\s*-{2,}\s*(?:Original Message|Forwarded [Mm]essage|Urspr\S+ Nachricht|Message d'origine|Mensaje original|转发邮件|原始邮件|元のメッセージ)\s*-{2,}\s*$")
_WROTE = re.compile(r"wrote\s*$|\bschrieb\b|a écrit\s*$|escribió\s*$|写道\s*$|さんは書きました\s*$")
_FIELD = re.compile(r"^\s*\*?(?:From|Sent|To|Cc|Date|Subject|Von|Gesendet|An|Betreff|De|Envoyé|À|Objet|Para|Asunto|Enviado)\s*:\*?\s")
_BLOCK = re.compile(r"(?:(?:R.c..v.d|From|To|Cc|Subj.ct|D.t.|M.ss.g.-ID|MIME-V.rs..n|C.nt.nt-[\w-]+|X-[\w-]+|In-R.ply-T.|R.f.r.nc.s|R.ply-T.|R.t.rn-P.th|S.nd.r|L.st-[\w-]+):[^\n]*(?:\n[ \t]+[^\n]+)*(?:\n|$)){2,}")
_INNER = re.compile(r"^--\S+\nContent-[\w-]+:", re.M)
_MARKUP = re.compile(r"\s*(?:<!--.*?-->\s*)*<(?:html|!doctype|body|div|p|table)\b", re.I | re.S)
_RULE = re.compile(r"^\s*(?:_{8,}|\*{3})\s*$")
_SIGN = re.compile(r"^--\s*$")
_CLOSE = re.compile(r"</(?:p|div|tr|li|h\d|table|ul|ol)>|<br\s*/?>|<(?:p|div|tr|li|h\d)(?:\s[^<>]*)?>", re.I)
_HIDDEN = re.compile(r"<(/?)(style|script|head|title|blockquote)\b[^<>]*>", re.I)
_ANCHOR = re.compile(r"""<a\s[^<>]*?href\s*=\s*["']?([^"'\s<>]+)["']?[^<>]*>([^<]*(?:<(?!/?a\b)[^<]*)*)</a>""", re.I)
_TAG = re.compile(r"<[^<>]+>")
_BREAK = re.compile(r"<br\s*/?>", re.I)
_LETTERS = re.compile(r"[^\W\d_]+")
#: Words of disclaimers; a line with two of them that reads as a sentence is one.
_CAUTION = re.compile(r"confidential|recipients?\b|attachments\b|liability|views are those|opinion in it|tell the sender|remove every copy|fictitious office|before printing|vertraulich|Empfänger|löschen Sie|confidentiel|destinataire|confidencial|destinatario", re.I)
_BASE64_LINES = re.compile(r"(?:^[A-Za-z0-9+/]{60,}={0,2}\s*$\n?){3,}", re.M)


#: Parts nested deeper than this are read as plain text, so that a hostile message can't exhaust the stack.
DEEPEST = 100


def _head_and_body(t: str) -> tuple[dict[str, str], str]:
    """Header fields of a part (folded lines joined, last of a name counts) and what follows the first empty line."""
    first = t.split("\n", 1)[0]
    if not _HEADER.match(first):
        return {}, t
    head, _, body = t.partition("\n\n")
    head = re.sub(r"\n[ \t]+", " ", head)
    fields = {}
    for line in head.split("\n"):
        name, colon, value = line.partition(":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    return fields, body


def _decoded(body: str, how: str, charset: str) -> str:
    if how == "quoted-printable":
        raw = quopri.decodestring(body.encode("utf-8", "replace"))
    elif how == "base64":
        packed = re.sub(r"[^A-Za-z0-9+/]", "", body)
        try:
            raw = base64.b64decode(packed[: len(packed) // 4 * 4] if len(packed) % 4 == 1 else packed + "=" * (-len(packed) % 4))
        except (binascii.Error, ValueError):
            return ""
    else:
        return body
    try:
        return raw.decode(charset or "utf-8", "strict")
    except (LookupError, UnicodeDecodeError):
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return raw.decode("latin-1")


def _without_hidden(t: str) -> str:
    """Text without the elements that aren't displayed or are quoted, in one pass: an element runs to its own end mark; a quote that is
    never closed runs to the end, other unclosed marks hide nothing."""
    marks = [(m.start(), m.end(), bool(m[1]), m[2].lower()) for m in _HIDDEN.finditer(t)]
    last_end = {name: at for at, _, closing, name in marks if closing}
    out, at, inside, depth = [], 0, "", 0
    for start, end, closing, name in marks:
        if inside:
            if name == inside:
                depth += -1 if closing else 1
                if depth == 0 or (closing and name != "blockquote"):
                    at, inside = end, ""
        elif not closing and (last_end.get(name, -1) > start or name == "blockquote"):
            out.append(t[at:start])
            inside, depth = name, 1
    if not inside:
        out.append(t[at:])
    return "\n".join(out)


def _from_html(t: str) -> str:
    t = _without_hidden(t)
    t = re.sub(r"[^\S\n]*\n\s*", " ", t) if "<br" in t.lower() or "<p" in t.lower() or "<div" in t.lower() else t
    t = _ANCHOR.sub(lambda m: f"{m[2]} {m[1]} ", t)
    t = _CLOSE.sub("\n", t)
    return html.unescape(_TAG.sub("", t))


def _parts(t: str, depth: int = 0) -> list[tuple[str, str]]:
    """(kind, text) of the displayed parts: of alternatives the plain one if it has words, else the other."""
    fields, body = _head_and_body(t)
    kind = fields.get("content-type", "text/plain")
    params = {m[1].lower(): m[2] or m[3] or "" for m in _PARAM.finditer(kind)}
    name = kind.split(";")[0].strip().lower() or "text/plain"
    if fields.get("content-disposition", "").lower().startswith("attachment"):
        return []
    if name.startswith("multipart/") and params.get("boundary") and depth < DEEPEST:
        mark = "--" + params["boundary"]
        pieces: list[list[str]] = []
        for line in body.split("\n"):
            s = line.rstrip()
            if s == mark:
                pieces.append([])
            elif s == mark + "--":
                break
            elif pieces:
                pieces[-1].append(line)
        got = [p for piece in pieces for p in _parts("\n".join(piece), depth + 1)]
        if name == "multipart/alternative":
            plain = [p for p in got if p[0] == "plain" and p[1].strip()]
            return plain or got
        return got
    if name.startswith("multipart/"):
        return _loose_parts(body, depth) if depth < DEEPEST else [("plain", body)]
    if name.startswith("text/"):
        if depth == 0 and _INNER.search(body):  # the header that named the boundary is lost
            return _loose_parts(_without_block(body), depth)
        text = _decoded(body, fields.get("content-transfer-encoding", "").strip().lower(), params.get("charset", ""))
        return [("html" if name == "text/html" else "plain", text)]
    return [("plain", body)] if depth == 0 and not name.startswith(("application/", "image/", "audio/", "video/", "multipart/")) else []


def _loose_parts(body: str, depth: int) -> list[tuple[str, str]]:
    """Parts between lines that look like boundaries."""
    got = [p for piece in re.split(r"^--\S+\s*$", body, flags=re.M) if _HEADER.match(piece.lstrip("\n")) for p in _parts(piece.lstrip("\n"), depth + 1)]
    plain = [p for p in got if p[0] == "plain" and p[1].strip()]
    return plain or got


def _without_block(text: str) -> str:
    """A header block that slipped into the text goes."""
    text = text.lstrip()
    while (m := _BLOCK.match(text)) is not None:
        text = text[m.end() :].lstrip()
    return text


def _displayed(message: str) -> list[str]:
    """The texts of the displayed parts, quotes included."""
    t = unicodedata.normalize("NFC", message).replace("\r\n", "\n").replace("\r", "\n").lstrip("\ufeff\u200b \t\n")
    t = re.sub(r"\A(?:From [^\n]*\n[\u200b\ufeff]?)+", "", t)  # a mailbox's separator line
    out = []
    for kind, text in _parts(t):
        text = text.replace("\r\n", "\n").replace("\r", "\n")
        text = _without_block(text) if kind == "plain" else text
        text = _from_html(text) if kind == "html" or _MARKUP.match(text) else _BREAK.sub("\n", text)
        text = _BASE64_LINES.sub("", text)
        out.append("\n".join(map(_reread, text.split("\n"))) if _MISREAD.search(text) else text)
    return out


def displayed_text(message: str) -> str:
    """What the message shows, quotes included."""
    return "\n".join(_displayed(message))


def _reread(line: str) -> str:
    """A line of UTF-8 that was read as Latin-1, read aright."""
    if _MISREAD.search(line):
        try:
            return line.encode("latin-1").decode("utf-8", "replace")
        except UnicodeEncodeError:
            pass
    return line


def _reads_as_caution(block: list[str]) -> bool:
    """Whether lines read as a disclaimer: its phrases, or sentences without links rather than a list of keywords."""
    text = " ".join(block)
    if len(_CAUTION.findall(text)) >= 2:
        return True
    words = _LETTERS.findall(text.lower())
    return "://" not in text and "www." not in text and len(words) <= 60 and len(set(words)) >= 0.6 * len(words) and bool(re.search(r"[.!?。]\s*$", text)) and len(re.findall(r"[,#|;]", text)) * 8 <= len(words)


def _own_lines(text: str) -> str:
    """A displayed text without quoted messages, signature and disclaimer.

    Quoted are marked lines, the line that announces them, and all below an "Original Message" line that a header block follows: what
    stands there unmarked can't be told from the quoted message. A signature runs to an empty line. What a rule sets off goes only if
    it reads as a disclaimer."""
    lines = text.split("\n")
    own: list[str] = []
    i, n = 0, len(lines)

    def next_line(k: int) -> str:
        while k < n and not lines[k].strip():
            k += 1
        return lines[k] if k < n else ""

    def block_end(k: int) -> int:
        while k < n and lines[k].strip() and not _QUOTE_LINE.match(lines[k]) and not _ORIGINAL.match(lines[k]):
            k += 1
        return k

    while i < n:
        line = lines[i]
        if _SIGN.match(line):
            i = block_end(i + 1)
            continue
        if _RULE.match(line):
            end = block_end(i + 1)
            i = end if _reads_as_caution(lines[i + 1 : end]) else i + 1
            continue
        if _ORIGINAL.match(line) and _FIELD.match(next_line(i + 1)):
            break
        if _QUOTE_LINE.match(line):
            i += 1
            continue
        if line.rstrip().endswith((":", "：")) and _WROTE.search(line.rstrip().rstrip(":：")) and (_QUOTE_LINE.match(next_line(i + 1)) or not next_line(i + 1)):
            i += 1
            continue
        if len(_CAUTION.findall(line)) >= 2:
            i += 1
            continue
        own.append(line)
        i += 1
    return "\n".join(own).strip()


def own_body(message: str | None) -> str:
    """The sender's own words; a part four fifths of whose words an earlier part has (the message as plain text and again as HTML) is left out."""
    if not message:
        return ""
    earlier: list[Counter[str]] = []
    out = []
    for text in _displayed(message):
        own = _own_lines(text)
        words = Counter(_LETTERS.findall(own))
        if own and not any((words & w).total() >= 0.8 * words.total() for w in earlier):
            earlier.append(words)
            out.append(own)
    return "\n".join(out)
