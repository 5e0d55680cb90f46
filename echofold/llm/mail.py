"""Raw mail messages: headers, parts, transfer encodings, and the words a sender wrote themself.

Plain string work, no mail library: a message is looked at once, and what is broken (a missing boundary, bad base64, an
unknown charset) is read as far as it goes instead of raising.
"""

from __future__ import annotations

import binascii
import html
import re

_HEADER = re.compile(r"(?:From [^\n]*\n)?((?:[!-9;-~]+:[^\n]*(?:\n[ \t][^\n]*)*(?:\n|$))+)")
_FIELD = re.compile(r"^([!-9;-~]+):[ \t]*([^\n]*(?:\n[ \t][^\n]*)*)", re.M)
_PARAM = {name: re.compile(name + r"""\s*=\s*(?:"([^"]*)"|([^\s;]+))""", re.I) for name in ("boundary", "charset", "format")}
_SOFT = re.compile(r"=[ \t]*\n")
_HEX = re.compile(r"((?:=[0-9A-Fa-f]{2})+)")
_DROP = re.compile(r"(?is)<(script|style|head|title)\b.*?</\1\s*>|<!--.*?-->")
_BREAK = re.compile(r"(?i)<(?:br|/p|/div|/tr|/li|/h\d|hr)\b[^>]*>\n?")
_TAG = re.compile(r"<[/!?A-Za-z][^<>]*>")


def lines_of(text: str) -> str:
    """All line ends as one ``\\n``."""
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


def split_headers(text: str) -> tuple[dict[str, str], str]:
    """Header fields (lower-case names, unfolded, the first of each holds) and the rest; no header: all is body."""
    m = _HEADER.match(text)
    if not m:
        return {}, text
    fields: dict[str, str] = {}
    for k, v in _FIELD.findall(m.group(1)):
        fields.setdefault(k.lower(), v.replace("\n", " "))
    return fields, text[m.end() :].removeprefix("\n")


def _param(value: str, name: str) -> str:
    m = _PARAM[name].search(value)
    return (m.group(1) or m.group(2) or "") if m else ""


def _bytes_to_text(data: bytes, charset: str) -> str:
    for c in (charset, "utf-8"):
        try:
            return data.decode(c)
        except (LookupError, UnicodeDecodeError, ValueError):
            pass
    return data.decode("latin-1")


def decode_body(body: str, encoding: str, charset: str) -> str:
    """Undo the transfer encoding of a part's body; what is no valid code stays as it stands."""
    encoding = encoding.strip().lower()
    if encoding == "base64":
        raw = re.sub(r"[^A-Za-z0-9+/]", "", body)
        raw = raw[: len(raw) - (len(raw) % 4 == 1)]
        try:
            return lines_of(_bytes_to_text(binascii.a2b_base64(raw + "=" * (-len(raw) % 4)), charset))
        except (binascii.Error, ValueError):
            return body
    if encoding == "quoted-printable" and "=" in body:
        body = _SOFT.sub("", body)
        return lines_of(_HEX.sub(lambda m: _bytes_to_text(bytes.fromhex(m.group(1).replace("=", "")), charset), body))
    return body


def strip_html(text: str) -> str:
    text = _DROP.sub(" ", text)
    return html.unescape(_TAG.sub(" ", _BREAK.sub("\n", text)))


def _parts(fields: dict[str, str], body: str):
    """(kind, decoded text) of the inline text parts, in order and however deep; kind is plain or html."""
    stack = [(fields, body)]
    while stack:
        fields, body = stack.pop()
        kind = fields.get("content-type", "text/plain")
        low = kind.lower().lstrip()
        boundary = _param(kind, "boundary") if low.startswith("multipart/") else ""
        if boundary:
            pieces = re.split(r"(?m)^--" + re.escape(boundary) + r"(?:--)?[ \t]*(?:\n|$)", body)[1:]
            # a part without header fields begins with an empty line
            stack += [({}, x[1:]) if x.startswith("\n") else split_headers(x) for x in reversed(pieces) if x.strip()]
            continue
        if "attachment" in fields.get("content-disposition", "").lower() or not low.startswith(("text/plain", "text/html", "text;")) and low.strip() != "text":
            continue
        text = decode_body(body, fields.get("content-transfer-encoding", ""), _param(kind, "charset") or "utf-8")
        yield ("html" if low.startswith("text/html") else "plain"), text


def body_text(message: str) -> str:
    """The decoded text of a message: its plain parts, or its HTML parts where no plain one says anything."""
    fields, body = split_headers(lines_of(message))
    parts = list(_parts(fields, body))
    plain = [t for k, t in parts if k == "plain"]
    if any(t.strip() for t in plain):
        return "\n\n".join(plain)
    return "\n\n".join(strip_html(t) for k, t in parts if k == "html")


_QUOTED = re.compile(r"[ \t]*[>＞]")
_RULED = re.compile(r"[ \t]*(?:[-_=*~]{5,}|\*(?: \*){2,})[ \t]*$")
_FORWARD = re.compile(r"[ \t]*-{2,}[ \t]*[^\W\d_][^\n]*[^\W_][ \t]*-{2,}[ \t]*$|(?:Begin forwarded message|Anfang der weitergeleiteten Nachricht|Début du message réexpédié)\s*:")
_FIELD_LINE = re.compile(r"[ \t]*(?:From|Von|De|От|From |Sent|Gesendet|Envoyé|Enviado|差出人|送信者|Date|Datum|Fecha)[ \t]?[:：]")
_SIGNATURE = re.compile(r"(?:--|__|==|~~|—|––)[ \t]*$")
_NAME = re.compile(r"[ \t]*[^\W\d_a-zа-яё][\w.'’-]*(?: [^\W\d_a-zа-яё][\w.'’-]*)?[ \t]*$")
_OPENING_END = (",", ":", "-", "–", "!", "様", "各位", "お疲れ様です。", "お世話になっております。")


def own_words(body: str) -> list[str]:
    """The paragraphs (lines joined by ``\\n``) that the sender wrote in this message.

    Left out: quoted lines with the line that introduces them, forwarded messages, signatures, greeting and closing. What
    can't be told apart stays in; notices are told from the corpus (``quality``), since they are the same under many messages.
    """
    lines = body.split("\n")
    paras: list[list[str]] = [[]]

    def end() -> None:
        if paras[-1]:
            paras.append([])

    i, n = 0, len(lines)
    while i < n:
        line = lines[i]
        bare = line.strip()
        if not bare:
            end()
        elif _QUOTED.match(line):
            # the introduction: what stands right above, up to three lines that end in a colon
            if not paras[-1] and len(paras) > 1:
                paras.pop()
            if paras[-1] and paras[-1][-1].rstrip().endswith((":", "：")) and (len(paras[-1]) <= 3 or len(paras[-1][-1]) < 160):
                if len(paras[-1]) <= 3:
                    paras[-1].clear()
                else:
                    paras[-1].pop()
            end()
            while i < n and (_QUOTED.match(lines[i]) or (not lines[i].strip() and i + 1 < n and _QUOTED.match(lines[i + 1]))):
                i += 1
            continue
        elif _SIGNATURE.match(bare):
            end()
            while i < n and lines[i].strip() and not _QUOTED.match(lines[i]):
                i += 1
            continue
        elif _FORWARD.match(line):
            break
        elif _RULED.match(line) and not (paras[-1] and i + 1 < n and lines[i + 1].strip() and paras[-1][-1].count(" ") > 3 and set(bare) <= {"-", "="}):
            after = next((x for x in lines[i + 1 : i + 4] if x.strip()), "")
            if _FIELD_LINE.match(after):
                break
            end()
        elif _FIELD_LINE.match(line) and i + 1 < n and _FIELD_LINE.match(lines[i + 1]) and not paras[-1]:
            break
        else:
            paras[-1].append(line)
        i += 1
    kept = [p for p in paras if p]
    if kept and len(kept) > 1 and len(kept[0]) == 1 and len(kept[0][0]) <= 48 and kept[0][0].rstrip().endswith(_OPENING_END) and kept[0][0].count(" ") <= 5:
        kept.pop(0)
    kept = [p for p in kept if not (len(p) == 2 and len(p[0]) <= 40 and p[0].count(" ") <= 4 and not re.search(r"[\d;|\t]", p[0]) and _NAME.match(p[1]))]
    return ["\n".join(p) for p in kept]
