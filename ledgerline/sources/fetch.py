"""The one part that talks to the outside: a paced, retrying fetcher. :mod:`.landing` runs it in tasks; alone it lands responses in a folder."""

from __future__ import annotations

import hashlib
import os
import tempfile
import threading
import time
from collections.abc import Callable
from urllib.parse import urlsplit

Transport = Callable[[str], tuple[int, dict[str, str], bytes]]
HOSTS = ("www.sec.gov", "data.sec.gov")


class Pace:
    """At most ``per_second`` starts a second, over all threads."""

    def __init__(
        self, per_second: float, clock: Callable[[], float] = time.monotonic,
        sleep: Callable[[float], None] = time.sleep
    ):
        if not 0 < per_second <= 10:
            raise ValueError("the service allows up to ten requests a second")
        self.gap, self.clock, self.sleep, self.lock, self.next = 1 / per_second, clock, sleep, threading.Lock(), 0.0

    def wait(self) -> None:
        with self.lock:
            now = self.clock()
            at = max(now, self.next)
            self.next = at + self.gap
        if at > now:
            self.sleep(at - now)


def checked_url(url: str) -> str:
    parts = urlsplit(url)
    if parts.scheme != "https" or parts.hostname not in HOSTS:
        raise ValueError(f"{url} is not of the service")
    return url


def landed_name(url: str, suffix: str = "") -> str:
    return hashlib.sha256(url.encode()).hexdigest() + suffix


class Fetcher:
    """Responses by URL, landed once in a folder; 429, server errors and broken connections are tried again, up to a minute apart."""

    def __init__(
        self, transport: Transport, folder: str, pace: Pace, tries: int = 5, sleep: Callable[[float], None] = time.sleep
    ):
        self.transport, self.folder, self.pace, self.tries, self.sleep = transport, folder, pace, tries, sleep

    def get(self, url: str, suffix: str = "", use_landed: bool = True) -> bytes:
        checked_url(url)
        path = os.path.join(self.folder, landed_name(url, suffix))
        if use_landed and os.path.exists(path):
            with open(path, "rb") as f:
                return f.read()
        body = self._request(url)
        os.makedirs(self.folder, exist_ok=True)
        handle, temporary = tempfile.mkstemp(dir=self.folder)
        with os.fdopen(handle, "wb") as f:
            f.write(body)
        os.replace(temporary, path)
        return body

    def fetched(self, url: str) -> bytes:
        """The response, not landed."""
        return self._request(checked_url(url))

    def _request(self, url: str) -> bytes:
        for n in range(self.tries):
            self.pace.wait()
            delay = min(60.0, 2.0**n)
            try:
                status, headers, body = self.transport(url)
            except OSError as e:
                if n == self.tries - 1:
                    raise ConnectionError(f"{url}: {e}") from e
            else:
                if status == 200:
                    return body
                if status != 429 and status < 500 or n == self.tries - 1:
                    raise ConnectionError(f"{url}: status {status}")
                told = headers.get("Retry-After", "")
                delay = min(60.0, float(told)) if told.isdigit() else delay
            self.sleep(delay)
        raise ConnectionError(url)
