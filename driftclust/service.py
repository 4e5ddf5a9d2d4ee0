"""HTTP façade over the engine, on the standard library."""

from __future__ import annotations

import hmac
import json
import re
import threading
import time
from collections.abc import Callable
from datetime import datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qs, urlsplit

from driftclust.engine import Item

MAX_ITEMS, MAX_ID, MAX_TEXT, MAX_BODY = 1000, 256, 20_000, 32 << 20


class Throttle:
    """Each request books the next free step of its client's time, a minute divided by ``per_minute``; none is booked more than a minute ahead.
    So a client may send ``per_minute`` requests at once and one a step from then on. Of more than ``clients`` clients those are
    forgotten whose bookings end first."""

    AHEAD = 60.0

    def __init__(self, per_minute: int = 600, clients: int = 10_000, clock: Callable[[], float] = time.monotonic):
        self._step, self._most, self._clock = self.AHEAD / per_minute, clients, clock
        self._booked_until: dict[str, float] = {}
        self._guard = threading.Lock()

    def admit(self, client: str) -> bool:
        with self._guard:
            now = self._clock()
            end = max(now, self._booked_until.get(client, now)) + self._step
            if end > now + self.AHEAD + 1e-6:
                return False
            self._booked_until[client] = end
            if len(self._booked_until) > self._most:
                keep = sorted(self._booked_until.items(), key=lambda c: c[1])[-max(1, self._most // 2) :]
                self._booked_until = {**dict(keep), client: end}
            return True


def plain(value: Any) -> Any:
    if hasattr(value, "asDict"):
        value = value.asDict(recursive=True)
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items() if k not in ("embedding",)}
    if isinstance(value, (list, tuple)) and not hasattr(value, "_asdict"):
        return [plain(v) for v in value]
    if hasattr(value, "_asdict"):
        return plain(value._asdict())
    return value.isoformat() if isinstance(value, datetime) else value


def _int(text: str, low: int, high: int, name: str) -> int:
    try:
        n = int(text)
    except ValueError:
        raise ValueError(f"{name} must be a whole number") from None
    if not low <= n <= high:
        raise ValueError(f"{name} must lie between {low} and {high}")
    return n


class Service:
    """Routes requests to an engine. ``handle`` is the whole of it, apart from sockets."""

    def __init__(self, engine, api_key: str | None = None, per_minute: int = 600):
        self.engine, self.api_key, self.limiter = engine, api_key, Throttle(per_minute)

    def handle(self, method: str, url: str, body: bytes = b"", headers: dict[str, str] | None = None, client: str = "") -> tuple[int, dict[str, Any]]:
        parts = urlsplit(url)
        path, query = parts.path.rstrip("/") or "/", parse_qs(parts.query)
        if (method, path) == ("GET", "/health"):
            return 200, {"ok": True, "data": {"status": "up"}}
        if not self.limiter.admit(client):
            return self._error(429, "too many requests")
        if self.api_key and not hmac.compare_digest((headers or {}).get("x-api-key", ""), self.api_key):
            return self._error(401, "a valid API key is needed")
        try:
            given = json.loads(body) if body else {}
            if not isinstance(given, dict):
                raise ValueError("the body must be a JSON object")
            found = self._route(method, path, query, given)
        except KeyError as e:
            return self._error(404, str(e.args[0]))
        except (ValueError, TypeError) as e:
            return self._error(400, str(e))
        except Exception:
            import logging

            logging.getLogger("driftclust.service").exception("a request failed")
            return self._error(500, "internal error")
        return (404, {"ok": False, "error": f"no {method} {path}"}) if found is None else (200, {"ok": True, "data": plain(found[0])})

    @staticmethod
    def _error(code: int, text: str) -> tuple[int, dict[str, Any]]:
        return code, {"ok": False, "error": text}

    def _items(self, given: dict) -> list[Item]:
        rows = given.get("items")
        if not isinstance(rows, list) or not 1 <= len(rows) <= MAX_ITEMS:
            raise ValueError(f"items must be a list of 1 to {MAX_ITEMS}")
        out = []
        for r in rows:
            if not isinstance(r, dict) or not isinstance(r.get("id"), str) or not isinstance(r.get("text"), str) or len(r["id"]) > MAX_ID or len(r["text"]) > MAX_TEXT:
                raise ValueError(f"each item needs an id of up to {MAX_ID} and a text of up to {MAX_TEXT} characters")
            at = r.get("timestamp")
            out.append(Item(r["id"], r["text"], datetime.fromisoformat(str(at).replace("Z", "+00:00")) if at else self.engine.clock.now(), r.get("metadata") or {}))
        return out

    def _route(self, method: str, path: str, query: dict[str, list[str]], given: dict) -> tuple | None:
        e = self.engine
        first = lambda name, default: query.get(name, [default])[0]
        need = lambda name: given[name] if isinstance(given.get(name), (str, list)) else (_ for _ in ()).throw(ValueError(f"{name} is needed"))
        if method == "POST":
            if path == "/items":
                return (e.ingest(self._items(given)).collect(),)
            if path == "/discover":
                return (e.discover(),)
            if path == "/sweep":
                return (e.sweep(),)
            if path == "/overrides/move":
                return (e.move_item(need("item_id"), need("cluster_id")),)
            if path == "/overrides/merge":
                return ({"survivor": e.merge_clusters(need("a"), need("b"), given.get("survivor"))},)
            if path == "/overrides/split":
                return ({"cluster_id": e.split_cluster(need("cluster_id"), need("item_ids"))},)
            if m := re.fullmatch(r"/clusters/([^/]+)/(close|reopen|unlock)", path):
                getattr(e, f"{m[2]}_cluster")(m[1])
                return (e.get_cluster(m[1]),)
        if method == "GET":
            if path == "/clusters":
                return (e.clusters(*query.get("status", [])).collect(),)
            if m := re.fullmatch(r"/clusters/([^/]+)", path):
                d = e.cluster_detail(m[1], _int(first("sample_size", "10"), 0, 100, "sample_size") or 1)
                return ({"cluster": d.cluster, "counts_over_time": d.counts_over_time.collect(), "sample": d.sample.collect()},)
            if m := re.fullmatch(r"/clusters/([^/]+)/sample", path):
                return (e.sample(m[1], _int(first("n", "10"), 1, 500, "n"), first("strategy", "mixed")).collect(),)
            if path == "/events":
                return (e.events(_int(first("after", "0"), 0, 2**62, "after"), _int(first("limit", "100"), 1, 1000, "limit")).collect(),)
            if path == "/stats":
                return (e.stats(),)
        return None


def server(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _answer(self):
            size = int(self.headers.get("content-length") or 0)
            if size > MAX_BODY:
                code, body = 413, {"ok": False, "error": "the body is too large"}
            else:
                code, body = service.handle(self.command, self.path, self.rfile.read(size) if size else b"", {k.lower(): v for k, v in self.headers.items()}, self.client_address[0])
            text = json.dumps(body, default=str).encode()
            self.send_response(code)
            self.send_header("content-type", "application/json")
            self.send_header("content-length", str(len(text)))
            self.end_headers()
            self.wfile.write(text)

        do_GET = do_POST = _answer

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer((host, port), Handler)
