"""A polite downloader that lands JSON files for Spark to read; it runs on the driver, outside any plan."""

from __future__ import annotations

import json
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from pathlib import Path


class Client:
    """GET with a user agent, a least interval between requests, and retries on 429, 5xx and transport errors."""

    def __init__(self, base: str, user_agent: str, most_per_second: float = 10.0, timeout: float = 30.0, retries: int = 3, opener: Callable | None = None, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        if not user_agent or not user_agent.strip():
            raise ValueError("a user agent is required")
        self.base, self.user_agent, self.timeout, self.retries = base.rstrip("/"), user_agent, timeout, retries
        self.interval = 1.0 / most_per_second
        self._open, self._sleep, self._clock = opener or urllib.request.urlopen, sleep, clock
        self._lock, self._next = threading.Lock(), 0.0

    def _wait(self) -> None:
        with self._lock:
            now = self._clock()
            at = max(now, self._next)
            self._next = at + self.interval
        if at > now:
            self._sleep(at - now)

    def get_json(self, path: str) -> dict:
        url = f"{self.base}/{path.lstrip('/')}"
        if url.startswith("file://"):
            return json.loads(Path(url[7:]).read_text())
        for attempt in range(self.retries + 1):
            self._wait()
            try:
                request = urllib.request.Request(url, headers={"User-Agent": self.user_agent})
                with self._open(request, timeout=self.timeout) as answer:
                    return json.loads(answer.read())
            except urllib.error.HTTPError as wrong:
                if wrong.code != 429 and wrong.code < 500 or attempt == self.retries:
                    raise
            except (urllib.error.URLError, TimeoutError, ConnectionError):
                if attempt == self.retries:
                    raise
            self._sleep(2**attempt)
        raise AssertionError

    def land(self, path: str, folder: str) -> str:
        """Fetch a file into a folder; returns where it lies."""
        where = Path(folder) / path.strip("/").replace("/", "_")
        where.parent.mkdir(parents=True, exist_ok=True)
        where.write_text(json.dumps(self.get_json(path)))
        return str(where)
