"""Downloads with retries, several at a time. The driver fetches; what it fetched is read from files."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

#: Answers that are worth another attempt, attempts, and the first and the longest wait in seconds between them: fixed values.
AGAIN, ATTEMPTS, FIRST_WAIT, LONGEST_WAIT = frozenset({429, 500, 502, 503, 504}), 5, 1.0, 30.0
TOGETHER = 3


def _open(url: str) -> bytes:
    with urllib.request.urlopen(url, timeout=60) as answer:
        return answer.read()


def fetch(url: str, *, get: Callable[[str], bytes] = _open, wait: Callable[[float], None] = time.sleep) -> bytes:
    """The body. Refused or broken connections and the answers in AGAIN are tried again, each time after twice the wait."""
    for attempt in range(ATTEMPTS):
        try:
            return get(url)
        except urllib.error.HTTPError as e:
            if e.code not in AGAIN or attempt == ATTEMPTS - 1:
                raise
        except OSError:  # URLError and time-outs are of this kind
            if attempt == ATTEMPTS - 1:
                raise
        wait(min(FIRST_WAIT * 2**attempt, LONGEST_WAIT))
    raise AssertionError


def gather(urls: Iterable[str], *, together: int = TOGETHER, **how: Callable) -> dict[str, bytes | Exception]:
    """Each address's body or what went wrong with it; one that fails stops no other."""

    def one(url: str) -> bytes | Exception:
        try:
            return fetch(url, **how)
        except Exception as e:  # noqa: BLE001
            return e

    urls = list(dict.fromkeys(urls))
    with ThreadPoolExecutor(together) as pool:
        return dict(zip(urls, pool.map(one, urls)))
