"""Status of a checked link: accepted codes, classes, retries, cache forms and their texts."""

from __future__ import annotations

import re
from collections.abc import Sequence
from http import HTTPStatus

from pyspark.sql import Column
from pyspark.sql import functions as F

STATUS = "struct<kind:string,code:int,error_kind:string,text:string,details:string,cached:boolean>"
LOWEST, HIGHEST = 100, 999
DEFAULT_ACCEPT = ((100, 103), (200, 299))  # fixed values
#: Reason phrases by code, as the standard library knows them, but for four fixed values.
REASONS = {s.value: s.phrase for s in HTTPStatus} | {413: "Payload Too Large", 416: "Range Not Satisfiable", 418: "I'm a teapot", 422: "Unprocessable Entity"}

OK, ERROR, REQUEST_ERROR, TIMEOUT = "Ok", "Error", "RequestError", "Timeout"
UNKNOWN_CODE, UNKNOWN_MAIL, EXCLUDED, UNSUPPORTED = "UnknownStatusCode", "UnknownMailStatus", "Excluded", "Unsupported"

Ranges = Sequence[tuple[int, int]]


def parse_range(text: str) -> tuple[int, int]:
    """``200``, ``200..300`` (300 not in it), ``200..=299``, ``..=299``, ``200..``; from 100 to 999."""
    m = re.fullmatch(r"(\d+)|(\d+)?\.\.(?:(=)?(\d+))?", text.strip())
    if not m or (m[3] and not m[4]):
        raise ValueError(f"no range of status codes: {text!r}")
    if m[1]:
        low = high = int(m[1])
    else:
        low = int(m[2]) if m[2] else LOWEST
        high = HIGHEST if m[4] is None else int(m[4]) if m[3] else int(m[4]) - 1
    if low > high:
        raise ValueError(f"the range ends before it starts: {text!r}")
    if low < LOWEST or high > HIGHEST:
        raise ValueError(f"status codes are {LOWEST} to {HIGHEST}: {text!r}")
    return low, high


def parse_ranges(text: str) -> tuple[tuple[int, int], ...]:
    """A comma list of ranges; one that overlaps the last one is merged with it."""
    out: list[tuple[int, int]] = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        low, high = parse_range(part)
        if out and low <= out[-1][1] and out[-1][0] <= high:
            out[-1] = (min(low, out[-1][0]), max(high, out[-1][1]))
        else:
            out.append((low, high))
    return tuple(out)


def accepted(code: Column, ranges: Ranges = DEFAULT_ACCEPT) -> Column:
    out = F.lit(False)
    for low, high in ranges:
        out = out | code.between(low, high)
    return F.coalesce(out, F.lit(False))


def retryable_code(code: Column) -> Column:
    return F.coalesce(code.between(500, 599) | code.isin(408, 429), F.lit(False))


def make(kind: Column | str, code: Column | None = None, error_kind: Column | None = None, text: Column | None = None, details: Column | None = None, cached: bool = False) -> Column:
    none = F.lit(None)
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(
        kind.alias("kind"),
        (none if code is None else code).cast("int").alias("code"),
        (none if error_kind is None else error_kind).cast("string").alias("error_kind"),
        (none if text is None else text).cast("string").alias("text"),
        (none if details is None else details).cast("string").alias("details"),
        F.lit(cached).alias("cached"),
    )


def reason(code: Column, otherwise: str) -> Column:
    table = F.create_map(*(F.lit(x) for kv in REASONS.items() for x in kv))
    return F.coalesce(F.try_element_at(table, code), F.lit(otherwise))


def code_text(code: Column) -> Column:
    return F.concat(code.cast("string"), F.lit(" "), reason(code, "<unknown status code>"))


def from_code(code: Column, ranges: Ranges = DEFAULT_ACCEPT) -> Column:
    """Ok for accepted codes, else a rejection."""
    rejected = F.concat(F.lit("Rejected status code: "), code.cast("string"), F.lit(" "), reason(code, "Unknown status code"))
    return F.when(accepted(code, ranges), make(OK, code, text=code_text(code), details=code_text(code))).otherwise(make(ERROR, code, F.lit("RejectedStatusCode"), rejected, rejected))


def from_failure(error_class: Column, message: Column, code: Column | None = None) -> Column:
    """Status of a request that failed: classes no_host, timeout, builder, body, decode; all others are network errors."""
    code = F.lit(None).cast("int") if code is None else code
    known = {"no_host": "InvalidUrlHost", "builder": "BuildRequestClient", "body": "ReadResponseBody", "decode": "ReadResponseBody"}
    name = F.try_element_at(F.create_map(*(F.lit(x) for kv in known.items() for x in kv)), error_class)
    timeout = error_class == "timeout"
    start = F.when(error_class == "builder", "Failed to create HTTP request client: ").when(error_class == "no_host", "URL is missing a hostname").otherwise("Failed to read response body: ")
    unsupported = F.concat(F.lit("Unsupported: "), start, F.when(error_class == "no_host", "").otherwise(message))
    advice = network_error_text(message)
    text = F.when(timeout, F.concat(F.lit("Timeout"), F.coalesce(F.concat(F.lit(" ("), code_text(code), F.lit(")")), F.lit("")))).when(name.isNotNull(), unsupported).otherwise(F.concat(F.lit("Network error: "), advice, F.lit(" ("), message, F.lit(")")))
    details = F.when(timeout, "Request timed out").when(name.isNotNull(), unsupported).otherwise(advice)
    kind = F.when(timeout, TIMEOUT).when(name.isNotNull(), UNSUPPORTED).otherwise(ERROR)
    return make(kind, F.when(error_class != "no_host", code), F.when(~timeout, F.coalesce(name, F.lit("NetworkRequest"))), text, details)


def should_retry(status: Column, retryable_network: Column | None = None) -> Column:
    """Timeouts, rejected 429s and network errors marked as passing; a rejected 500 is not retried."""
    kind, code, error = status["kind"], status["code"], status["error_kind"]
    network = F.lit(False) if retryable_network is None else F.coalesce(retryable_network, F.lit(False))
    return F.coalesce((kind == TIMEOUT) | ((kind == ERROR) & (((error == "RejectedStatusCode") & (code == 429)) | ((error == "NetworkRequest") & network))), F.lit(False))


def is_success(status: Column) -> Column:
    return status["kind"] == OK


def is_error(status: Column) -> Column:
    """Errors of any kind; timeouts are among them."""
    return status["kind"].isin(ERROR, REQUEST_ERROR, TIMEOUT)


def status_class(status: Column) -> Column:
    """The one class that a response counts for; timeouts come before errors."""
    k = status["kind"]
    return F.when(k == TIMEOUT, "timeout").when(k.isin(ERROR, REQUEST_ERROR), "error").when(k == EXCLUDED, "excluded").when(k == UNSUPPORTED, "unsupported").when(k == OK, "success").otherwise("unknown")


def code_shown(status: Column) -> Column:
    """What stands in brackets before a response: the code or a word for the kind."""
    k, code = status["kind"], status["code"].cast("string")
    word = F.when(k == UNKNOWN_MAIL, "UNKNOWN").when(k == EXCLUDED, "EXCLUDED").when(k == TIMEOUT, "TIMEOUT").when(k == UNSUPPORTED, "IGNORED").otherwise("ERROR")
    coded = k.isin(OK, UNKNOWN_CODE, TIMEOUT) | ((k == ERROR) & (status["error_kind"].isin("RejectedStatusCode", "ReadResponseBody", "BuildRequestClient") | status["cached"]))
    return F.when(coded & code.isNotNull(), code).otherwise(word)


# Cache forms: text of the stored column, and kinds that come back from it.


def cache_text(status: Column) -> Column:
    """Stored form: the code, ``Excluded``, ``Unsupported`` or ``Error``."""
    k = status["kind"]
    return F.when(k == EXCLUDED, "Excluded").when(k.isin(UNSUPPORTED, UNKNOWN_MAIL, UNKNOWN_CODE), "Unsupported").when(status["code"].isNotNull(), status["code"].cast("string")).otherwise("Error")


def cache_kind(text: Column) -> Column:
    """struct(kind, code) of a stored text: 2xx codes are Ok, other codes and junk errors."""
    code = F.when(text.rlike(r"^\d{3,4}$"), F.try_to_number(text, F.lit("9999")).cast("int"))
    known = F.when(code.between(LOWEST, HIGHEST), code)
    kind = F.when(text == "Excluded", EXCLUDED).when(text == "Unsupported", UNSUPPORTED).when(known.between(200, 299), OK).otherwise(ERROR)
    return F.struct(kind.alias("kind"), F.when(kind.isin(OK, ERROR), known).alias("code"))


def from_cache(cached: Column, ranges: Ranges = DEFAULT_ACCEPT) -> Column:
    """Status of a cache hit: Ok stays Ok, an error becomes Ok if its code is accepted now."""
    kind = F.when((cached["kind"] == ERROR) & accepted(cached["code"], ranges), OK).otherwise(cached["kind"])
    text = F.when(kind == OK, "OK (cached)").when(kind == ERROR, "Error (cached)").when(kind == EXCLUDED, "Excluded (cached)").otherwise("Unsupported (cached)")
    return make(kind, cached["code"], None, text, text, cached=True)


def mail_status(result: Column, why: Column) -> Column:
    fine = code_text(F.lit(200))
    return (
        F.when(result == "success", make(OK, F.lit(200), text=fine, details=fine))
        .when(result == "uncertain", make(UNKNOWN_MAIL, text=F.lit("Unknown mail status"), details=why))
        .otherwise(make(ERROR, None, F.lit("UnreachableEmailAddress"), F.lit("Unreachable mail address"), why))
    )


# Texts for network errors, by what their message holds; the first that fits counts.
TLS_ADVICE = "TLS handshake failed. Check SSL/TLS configuration"
CERTIFICATE_RULES = (
    (("expired", "NotValidAtThisTime", "certificate has expired", "certificate is not valid on"), "SSL certificate expired. Site needs to renew certificate"),
    (("hostname", "NotValidForName"), "SSL certificate hostname mismatch. Check URL spelling"),
    (("self signed", "UnknownIssuer", "not trusted"), "SSL certificate not trusted. Use --insecure if site is trusted"),
    (("verify failed",), "SSL certificate verification failed. Check certificate validity"),
    (("certificate",), "SSL certificate error. Check certificate validity"),
)
NETWORK_RULES = (
    (("failed to lookup address", "nodename nor servname"), "DNS resolution failed. Check hostname and DNS settings"),
    (("Temporary failure in name resolution",), "DNS temporarily unavailable. Try again later"),
    (("protocol version",), "TLS protocol version mismatch. The client and server cannot agree on a TLS version. This is often due to outdated system TLS libraries or the server TLS settings."),
    (("handshake", "TLS", "SSL"), TLS_ADVICE),
    (("name resolution", "hostname"), "DNS resolution failed. Check hostname and DNS settings"),
    (("Connection refused", "connection refused"), "Connection refused. Server is not accepting connections (check if service is running)"),
    (("Connection reset", "connection reset"), "Connection reset by server. Server forcibly closed connection"),
    (("No route to host", "no route"), "No route to host. Check network routing or firewall configuration"),
    (("Network is unreachable", "network unreachable"), "Network unreachable. Check internet connection or VPN settings"),
    (("timed out", "timeout"), "Request timed out. Try increasing timeout or check server status"),
    (("connection error",), "Connection failed. Check network connectivity and firewall settings"),
    (("http2 error",), "HTTP/2 protocol error. Server may not support HTTP/2 properly"),
    (("channel closed",), "HTTP connection channel closed unexpectedly"),
    (("operation was canceled",), "HTTP operation was canceled before completion"),
    (("message head is too large",), "HTTP headers too large. Server response headers exceed limits"),
    (("invalid content-length",), "Invalid Content-Length header from server"),
)


def network_error_text(message: Column) -> Column:
    """Advice for a network error by its message. The rules are a literal that a lambda walks, so the code of a plan stays small."""
    either = lambda words: "|".join(re.escape(w) for w in words)
    rules = [(f"(?s)^(?=.*certificate).*(?:{either(w)})", t) for w, t in CERTIFICATE_RULES]
    rules.append(("(?s)^(?=.*protocol).*not supported", "Protocol not supported. Check URL scheme (http/https)"))
    rules += [(f"(?:{either(w)})", t) for w, t in NETWORK_RULES]
    table = F.array(*(F.struct(F.lit(p).alias("pattern"), F.lit(t).alias("text")) for p, t in rules))
    found = F.filter(table, lambda r: F.regexp_like(message, r["pattern"]))
    return F.coalesce(F.get(found, F.lit(0))["text"], F.concat(F.lit("Request failed: "), message))
