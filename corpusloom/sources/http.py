"""A download client for :func:`corpusloom.sources.files.fetch`: time limits, redirects, size checks."""

from __future__ import annotations

import http.client
import socket
from urllib.parse import urljoin, urlsplit

from corpusloom.settings import Settings

_MOVED = (301, 302, 303, 307, 308)


def _ask(method: str, url: str, s: Settings) -> tuple[http.client.HTTPConnection, http.client.HTTPResponse, str]:
    """The open answer after at most ``max_redirects`` redirects, and the address that gave it.

    What may go better another time (no connection, no proper answer) is a ``ConnectionError``; time limits are
    ``TimeoutError`` of themselves."""
    for _ in range(s.max_redirects + 1):
        at = urlsplit(url)
        if at.scheme not in ("http", "https"):
            raise ValueError(f"Unsupported scheme '{at.scheme}'. Only http and https are accepted.")
        kind = http.client.HTTPSConnection if at.scheme == "https" else http.client.HTTPConnection
        link = kind(at.hostname or "", at.port, timeout=s.connect_timeout_s)
        try:
            link.connect()
            link.sock.settimeout(s.read_timeout_s)
            link.request(method, (at.path or "/") + (f"?{at.query}" if at.query else ""), headers={"User-Agent": s.user_agent, "Accept": "*/*"})
            answer = link.getresponse()
        except (socket.gaierror, http.client.HTTPException) as e:
            link.close()
            raise ConnectionError(str(e) or type(e).__name__) from e
        except OSError:
            link.close()
            raise
        to = answer.getheader("Location")
        if answer.status not in _MOVED or not to:
            return link, answer, url
        link.close()
        url = urljoin(url, to)
    raise ValueError(f"Exceeded maximum allowed redirects ({s.max_redirects}).")


def download(url: str, s: Settings) -> tuple[bytes, str, str]:
    """(body, content type, final address). A body over ``max_url_bytes`` is refused by its announced length before it is
    asked for, and never read beyond that many bytes."""
    try:
        link, head, _ = _ask("HEAD", url, s)
        link.close()
        told = head.getheader("Content-Length") or ""
    except (OSError, ValueError):
        told = ""  # servers need not answer HEAD
    if told.isdigit() and int(told) > s.max_url_bytes:
        raise ValueError(f"Content-Length {told} exceeds max allowed size {s.max_url_bytes} bytes. Refusing to download.")
    link, answer, final = _ask("GET", url, s)
    try:
        if answer.status >= 400:
            raise ValueError(f"HTTP {answer.status}: {answer.reason}")
        body = answer.read(s.max_url_bytes + 1)
    except http.client.HTTPException as e:
        raise ConnectionError(str(e) or type(e).__name__) from e
    finally:
        link.close()
    return body, answer.getheader("Content-Type") or "", final
