"""URL parsing and serialisation by the WHATWG URL Standard, for the cases that Column expressions cannot decide.

``parse(text, base)`` gives a ``Url`` or raises ``UrlError`` with the reason. Results
are immutable, so they can be shared between rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import cache

#: Default ports of the special schemes (fixed values of the standard).
SPECIAL = {"ftp": 21, "file": None, "http": 80, "https": 443, "ws": 80, "wss": 443}

# Percent-encode sets of the standard, without the C0 controls and the bytes above 0x7E that all of them have.
FRAGMENT_SET = frozenset(' "<>`')
QUERY_SET = frozenset(' "#<>')
SPECIAL_QUERY_SET = QUERY_SET | {"'"}
PATH_SET = QUERY_SET | frozenset("?^`{}")
USERINFO_SET = PATH_SET | frozenset("/:;=@[\\]|")
FORBIDDEN_HOST = frozenset("\0\t\n\r #/:<>?@[\\]^|")
FORBIDDEN_DOMAIN = FORBIDDEN_HOST | frozenset(map(chr, range(0x20))) | {"%", "\x7f"}

_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.\-]*):")
_DRIVE = re.compile(r"[A-Za-z][:|]$")
_AROUND = "".join(map(chr, range(0x21)))
_LINE_ENDS = re.compile(r"[\t\n\r]")
_SLASHES = re.compile(r"[/\\]{2}")
_HOST_AND_PORT = re.compile(r"(\[[^\]]*\]|[^:]*)(?::(.*))?", re.S)
_STARTS_WITH_DRIVE = re.compile(r"[A-Za-z][:|](?:[/\\?#]|$)")


class UrlError(ValueError):
    """Why a text is no URL."""


@dataclass(frozen=True)
class Url:
    scheme: str
    username: str = ""
    password: str = ""
    host: str | None = None
    port: int | None = None
    path: tuple[str, ...] | str = ()
    query: str | None = None
    fragment: str | None = None

    @property
    def opaque(self) -> bool:
        return isinstance(self.path, str)

    @property
    def special(self) -> bool:
        return self.scheme in SPECIAL

    @property
    def path_text(self) -> str:
        return self.path if self.opaque else "".join(f"/{p}" for p in self.path)

    def __str__(self) -> str:
        out = self.scheme + ":"
        if self.host is not None:
            out += "//"
            if self.username or self.password:
                out += self.username + (f":{self.password}" if self.password else "") + "@"
            out += self.host + ("" if self.port is None else f":{self.port}")
        elif not self.opaque and len(self.path) > 1 and self.path[0] == "":
            out += "/."
        out += self.path_text
        if self.query is not None:
            out += f"?{self.query}"
        return out if self.fragment is None else f"{out}#{self.fragment}"


@cache
def _encoded(chosen: frozenset[str]) -> re.Pattern:
    """Characters that are encoded."""
    return re.compile("[^ -~]" + "".join("|" + re.escape(c) for c in sorted(chosen)))


def percent_encode(text: str, chosen: frozenset[str]) -> str:
    pattern = _encoded(chosen)
    if not pattern.search(text):
        return text
    return pattern.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "replace")), text)


def percent_decode(text: str) -> bytes:
    if "%" not in text:
        return text.encode("utf-8", "replace")
    return re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), text.encode("utf-8", "replace"))


def _ipv4_number(part: str) -> int | None:
    if not part:
        return None
    base, digits = 10, part
    if part[:2].lower() == "0x":
        base, digits = 16, part[2:]
    elif len(part) > 1 and part[0] == "0":
        base, digits = 8, part[1:]
    if not digits:
        return 0
    try:
        return int(digits, base) if re.fullmatch(r"[0-9A-Fa-f]+", digits) else None
    except ValueError:
        return None


def _ipv4(host: str) -> str | None:
    """Dotted form if the host ends in a number, else None."""
    parts = host.split(".")
    if parts[-1] == "" and len(parts) > 1:
        parts.pop()
    if not parts[-1][:1].isdigit():
        return None
    if not (parts[-1].isdigit() and parts[-1].isascii()) and _ipv4_number(parts[-1]) is None:
        return None
    numbers = [_ipv4_number(p) for p in parts]
    if len(parts) > 4 or None in numbers or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        raise UrlError("invalid IPv4 address")
    value = numbers[-1] + sum(n << 8 * (3 - k) for k, n in enumerate(numbers[:-1]))
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def _ipv6(text: str) -> str:
    import ipaddress

    if "%" in text:
        raise UrlError("invalid IPv6 address")
    try:
        packed = ipaddress.IPv6Address(text).packed
    except ValueError:
        raise UrlError("invalid IPv6 address") from None
    pieces = [packed[k] << 8 | packed[k + 1] for k in range(0, 16, 2)]
    runs = [(m.end() - m.start(), -m.start()) for m in re.finditer("0{2,}", "".join("0" if p == 0 else "1" for p in pieces))]
    shown = [f"{p:x}" for p in pieces]
    if not runs:
        return f"[{':'.join(shown)}]"
    size, start = max(runs)
    return f"[{':'.join(shown[:-start])}::{':'.join(shown[-start + size:])}]"


def _to_ascii(domain: str) -> str:
    if domain.isascii():
        return domain.lower()
    try:
        import idna

        return idna.encode(domain, uts46=True, transitional=False, std3_rules=False).decode("ascii").lower()
    except Exception:
        try:
            return domain.encode("idna").decode("ascii").lower()
        except UnicodeError:
            raise UrlError("invalid international domain name") from None


def parse_host(text: str, special: bool) -> str:
    if text.startswith("["):
        if not text.endswith("]"):
            raise UrlError("invalid IPv6 address")
        return _ipv6(text[1:-1])
    if not special:
        if not FORBIDDEN_HOST.isdisjoint(text):
            raise UrlError("invalid international domain name")
        return percent_encode(text, frozenset())
    domain = _to_ascii(percent_decode(text).decode("utf-8", "replace"))
    if not domain:
        raise UrlError("empty host")
    if not FORBIDDEN_DOMAIN.isdisjoint(domain):
        raise UrlError("invalid international domain name")
    return _ipv4(domain) or domain


def _walk(start: list[str], text: str, scheme: str) -> tuple[str, ...]:
    """Applies the segments of a path text to those that are there."""
    out = list(start)
    special = scheme in SPECIAL
    segments = (text.replace("\\", "/") if special else text).split("/")
    for k, raw in enumerate(segments):
        last = k == len(segments) - 1
        low = raw.lower().replace("%2e", ".") if "." in raw or "%" in raw else ""
        if low == "..":
            if out and not (scheme == "file" and len(out) == 1 and _DRIVE.match(out[0])):
                out.pop()
            if last:
                out.append("")
        elif low == ".":
            if last:
                out.append("")
        else:
            if scheme == "file" and not out and _DRIVE.match(raw):
                raw = raw[0] + ":"
            out.append(percent_encode(raw, PATH_SET))
    return tuple(out)


def _authority(text: str, scheme: str) -> dict:
    userinfo, at, hostport = text.rpartition("@")
    found: dict = {}
    if at:
        name, _, word = userinfo.partition(":")
        found["username"], found["password"] = percent_encode(name, USERINFO_SET), percent_encode(word, USERINFO_SET)
    m = _HOST_AND_PORT.fullmatch(hostport)
    if not m:
        raise UrlError("invalid port number")
    host, port = m[1], m[2]
    if not host and (at or port is not None or scheme in SPECIAL):
        raise UrlError("empty host")
    found["host"] = parse_host(host, scheme in SPECIAL) if host else ""
    if port:
        if not (port.isdigit() and port.isascii()) or int(port) > 65535:
            raise UrlError("invalid port number")
        found["port"] = None if int(port) == SPECIAL.get(scheme) else int(port)
    return found


def parse(text: str, base: Url | None = None) -> Url:
    text = _LINE_ENDS.sub("", text.strip(_AROUND))
    text, hashed, fragment = text.partition("#")
    tail = {"fragment": percent_encode(fragment, FRAGMENT_SET) if hashed else None}
    m = _SCHEME.match(text)
    if m:
        scheme, rest = m[1].lower(), text[m.end() :]
        if scheme in SPECIAL and scheme != "file":
            if base is not None and base.scheme == scheme and not _SLASHES.match(rest):
                return _relative(rest, base, tail)
            return _with_authority(scheme, rest.lstrip("/\\"), tail)
        if scheme == "file":
            return _file(rest, base if base is not None and base.scheme == "file" else None, tail)
        if rest.startswith("//"):
            return _with_authority(scheme, rest[2:], tail)
        body, asked, query = rest.partition("?")
        tail["query"] = percent_encode(query, QUERY_SET) if asked else None
        if rest.startswith("/"):
            return Url(scheme, path=_walk([], body[1:], scheme), **tail)
        return Url(scheme, path=percent_encode(body, frozenset()), **tail)
    if base is None:
        raise UrlError("relative URL without a base")
    if base.opaque:
        if text or not hashed:
            raise UrlError("relative URL with a cannot-be-a-base base")
        return replace(base, **tail)
    if base.scheme == "file":
        return _file(text, base, tail)
    return _relative(text, base, tail)


def _query(text: str, scheme: str, tail: dict) -> str:
    body, asked, query = text.partition("?")
    tail["query"] = percent_encode(query, SPECIAL_QUERY_SET if scheme in SPECIAL else QUERY_SET) if asked else None
    return body


def _with_authority(scheme: str, rest: str, tail: dict) -> Url:
    cut = re.search(r"[/\\?]" if scheme in SPECIAL else r"[/?]", rest)
    at = cut.start() if cut else len(rest)
    found = _authority(rest[:at], scheme)
    body = _query(rest[at:], scheme, tail)
    path = _walk([], body[1:], scheme) if body else (("",) if scheme in SPECIAL else ())
    return Url(scheme, path=path, **found, **tail)


def _relative(text: str, base: Url, tail: dict) -> Url:
    slash = r"[/\\]" if base.special else "/"
    if re.match(slash * 2, text):
        return _with_authority(base.scheme, text[2:].lstrip("/\\") if base.special else text[2:], tail)
    body = _query(text, base.scheme, tail)
    if re.match(slash, body):
        return replace(base, path=_walk([], body[1:], base.scheme), **tail)
    if not body:
        if tail["query"] is None:
            tail["query"] = base.query
        return replace(base, **tail)
    return replace(base, path=_walk(list(base.path[:-1]), body, base.scheme), **tail)


def _file(text: str, base: Url | None, tail: dict) -> Url:
    body = _query(text, "file", tail)
    if re.match(r"[/\\]{2}", body):
        rest = body[2:]
        cut = re.search(r"[/\\]", rest)
        at = cut.start() if cut else len(rest)
        name = rest[:at]
        if _DRIVE.match(name):
            return Url("file", host="", path=_walk([], rest, "file"), **tail)
        host = parse_host(name, True) if name else ""
        path = rest[at:]
        return Url("file", host="" if host == "localhost" else host, path=_walk([], path[1:], "file") if path else ("",), **tail)
    host = base.host if base is not None and base.host is not None else ""
    if re.match(r"[/\\]", body):
        drive = [base.path[0]] if base is not None and not _STARTS_WITH_DRIVE.match(body[1:]) and base.path and re.fullmatch("[A-Za-z]:", base.path[0]) else []
        return Url("file", host=host, path=_walk(drive, body[1:], "file"), **tail)
    if base is None or _STARTS_WITH_DRIVE.match(body):
        return Url("file", host=host, path=_walk([], body, "file"), **tail)
    if not body:
        if tail["query"] is None:
            tail["query"] = base.query
        return replace(base, **tail)
    return Url("file", host=host, path=_walk(list(base.path[:-1]), body, "file"), **tail)


def make_relative(base: Url, target: Url) -> str | None:
    """The reference that leads from ``base`` to ``target``, None if they share no origin."""
    if base.opaque or target.opaque or (base.scheme, base.host, base.port) != (target.scheme, target.host, target.port):
        return None
    a, b = list(base.path[:-1]), list(target.path[:-1])
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    name = target.path[-1] if target.path else ""
    out = "/".join([".."] * (len(a) - k) + b[k:] + [name]) if a[k:] or b[k:] or (base.path[-1:] != target.path[-1:]) else ""
    if target.query is not None:
        out += f"?{target.query}"
    return out if target.fragment is None else f"{out}#{target.fragment}"
