"""Language models: what one has to offer, an offline one, and wrappers.

A provider is an object with chat(prompt, request_type) -> Response.  It is called in Python
workers, from batches, so it has to be picklable.
"""

from __future__ import annotations

import json
import re
import socket
import socketserver
import threading
import time
import urllib.request
from collections import Counter, OrderedDict, deque
from dataclasses import dataclass
from typing import Protocol

REQUEST_TYPES = ("COMPREHEND_CHUNK", "GENERATE_SUMMARY", "CLUSTER_DOCUMENTS", "DECIDE_NAVIGATION", "EXTRACT_KEYWORDS", "EXTRACT_ENTITIES", "GENERATE_EXAMPLE_QUESTIONS", "EXTRACT_QUERY_KEYWORDS", "ANSWER_QUESTION")
#: Which of an installation's models answers a type.
SLOTS = {t: "heavy" for t in REQUEST_TYPES[:3]} | {t: "light" for t in REQUEST_TYPES[4:7]} | {t: "fast" for t in ("DECIDE_NAVIGATION", "EXTRACT_QUERY_KEYWORDS", "ANSWER_QUESTION")}
#: What separates a prompt's instructions from its variable part; caches compare the latter.
MARK = "\n---\n"


@dataclass(frozen=True)
class Response:
    content: str
    input_tokens: int = 0
    output_tokens: int = 0
    duration_ms: int = 0
    success: bool = True
    error: str | None = None

    @property
    def total_tokens(self) -> int:
        return self.input_tokens + self.output_tokens

    @staticmethod
    def failure(error: str) -> Response:
        return Response("", success=False, error=error)


class Provider(Protocol):
    def chat(self, prompt: str, request_type: str) -> Response: ...


_TERM = re.compile(r"[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ0-9]+|[一-鿿]{2}")
_NAME = re.compile(r"\b[A-ZÀ-Þ][a-zà-ÿ]+[0-9]*\b")


def top_terms(text: str, k: int = 8) -> list[str]:
    """The most frequent terms of a text in lower case, equals by name: words, and pairs of ideographs."""
    counts = Counter(m.lower() for m in _TERM.findall(text))
    return [t for t, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:k]]


def first_sentence(text: str, most: int = 200) -> str:
    flat = " ".join(text.split())
    m = re.search(r".*?(?:[。！？]|[.!?](?=\s|$))", flat)
    return (m.group(0) if m else flat)[:most]


class OfflineProvider:
    """A deterministic provider that quotes: frequent terms, first sentences, names, and choices by shared terms.

    Prompts are `instructions MARK variable part`; see prompts of this package.
    """

    def chat(self, prompt: str, request_type: str) -> Response:
        text = prompt.split(MARK, 1)[-1]
        answer = getattr(self, f"_{request_type.lower()}", None)
        if answer is None:
            return Response.failure(f"unknown request type {request_type}")
        content = answer(text)
        return Response(content, len(prompt) // 4, len(content) // 4)

    def _comprehend_chunk(self, text: str) -> str:
        words = [{"keyword": t, "definition": "", "context": ""} for t in top_terms(text)]
        return json.dumps({"summary": first_sentence(text), "keywordDefinitions": words, "entities": self._names(text), "exampleQuestions": self._questions(text)}, ensure_ascii=False)

    def _generate_summary(self, text: str) -> str:
        return first_sentence(text, 500)

    def _cluster_documents(self, text: str) -> str:
        """Lines '[i] summary', by their most frequent term."""
        groups: OrderedDict[str, list[int]] = OrderedDict()
        for i, line in re.findall(r"^\[(\d+)\] ?(.*)$", text, re.M):
            groups.setdefault((top_terms(line, 1) or [""])[0], []).append(int(i))
        return json.dumps({"clusters": [{"name": k, "chunkIndices": v} for k, v in groups.items()]}, ensure_ascii=False)

    def _decide_navigation(self, text: str) -> str:
        """A query, then lines '[i] child': the child that shares most terms with the query; none, then fall back."""
        query, _, rest = text.partition("\n")
        wanted = set(top_terms(query, 1000))
        shared = [(len(wanted & set(top_terms(line, 1000))), -int(i)) for i, line in re.findall(r"^\[(\d+)\] ?(.*)$", rest, re.M)]
        best = max(shared, default=(0, 0))
        if best[0] == 0:
            return json.dumps({"action": "fallback_search", "reasoning": "no shared term", "confidence": 0.5})
        return json.dumps({"action": "select_child", "selectedIndex": -best[1], "reasoning": "shared terms", "confidence": 0.9})

    def _extract_keywords(self, text: str) -> str:
        return json.dumps(top_terms(text), ensure_ascii=False)

    def _names(self, text: str) -> list[str]:
        return list(dict.fromkeys(_NAME.findall(text)))[:8]

    def _extract_entities(self, text: str) -> str:
        return json.dumps(self._names(text), ensure_ascii=False)

    def _questions(self, text: str) -> list[str]:
        return [f"{t}?" for t in top_terms(text, 3)]

    def _generate_example_questions(self, text: str) -> str:
        return json.dumps(self._questions(text), ensure_ascii=False)

    def _extract_query_keywords(self, text: str) -> str:
        return "\n".join(top_terms(text))

    def _answer_question(self, text: str) -> str:
        return first_sentence(text.partition("\n")[2] or text, 1000)


class ScriptedProvider:
    """Answers from a function (prompt, request type) -> text; an exception is a failed call."""

    def __init__(self, answer) -> None:
        self.answer = answer

    def chat(self, prompt: str, request_type: str) -> Response:
        try:
            return Response(self.answer(prompt, request_type))
        except Exception as e:
            return Response.failure(str(e))


class SlotProvider:
    """Routes request types to the providers of the slots heavy, light and fast."""

    def __init__(self, **slots: Provider) -> None:
        self.slots = slots

    def chat(self, prompt: str, request_type: str) -> Response:
        provider = self.slots.get(SLOTS.get(request_type, "fast")) or next(iter(self.slots.values()))
        try:
            return provider.chat(prompt, request_type)
        except Exception as e:
            return Response.failure(str(e))


class CachedProvider:
    """Keeps successful answers by type and prompt, within sizes and idle times; failed calls are asked again.

    With similar=True a prompt whose variable part is alike enough to a kept one's takes its answer;
    the last 100 are looked at.
    """

    def __init__(self, inner: Provider, limits: dict[str, tuple[int, int] | None], similar: bool = False) -> None:
        self.inner, self.limits, self.similar = inner, limits, similar
        self.hits = self.misses = 0
        self._kept: dict[str, OrderedDict[str, tuple[float, Response]]] = {}
        self._lock = threading.RLock()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_lock"} | {"_kept": {}}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._lock = threading.RLock()

    def chat(self, prompt: str, request_type: str) -> Response:
        limit = self.limits.get(request_type)
        if limit is None:
            return self.inner.chat(prompt, request_type)
        with self._lock:
            kept, now = self._kept.setdefault(request_type, OrderedDict()), time.monotonic()
            for key in [k for k, (t, _) in kept.items() if now - t > limit[1] * 3600]:
                del kept[key]
            found = prompt if prompt in kept else self._alike(prompt, kept) if self.similar else None
            if found is not None:
                self.hits += 1
                answer = kept[found][1]
                kept[prompt] = (now, answer)
                kept.move_to_end(prompt)
                return answer
            self.misses += 1
        answer = self.inner.chat(prompt, request_type)  # others may ask meanwhile
        if answer.success:
            with self._lock:
                kept[prompt] = (now, answer)
                while len(kept) > limit[0]:
                    kept.popitem(last=False)
        return answer

    @staticmethod
    def _alike(prompt: str, kept: OrderedDict) -> str | None:
        norm = lambda p: " ".join(p.split(MARK, 1)[-1].lower().split())
        a = norm(prompt)
        for key in list(reversed(kept))[:100]:
            b = norm(key)
            if a == b or (max(len(a), len(b)) <= 500 and edit_similarity(a, b) >= 0.85):
                return key
        return None

    def clear(self, request_type: str | None = None) -> None:
        with self._lock:
            for t in [request_type] if request_type else list(self._kept):
                self._kept.pop(t, None)

    def warm(self, request_type: str, answers: dict[str, str]) -> None:
        with self._lock:
            for p, a in answers.items():
                self._kept.setdefault(request_type, OrderedDict())[p] = (time.monotonic(), Response(a))

    def sizes(self) -> dict[str, int]:
        return {t: len(k) for t, k in self._kept.items()}

    def statistics(self) -> dict[str, float]:
        asked = self.hits + self.misses
        return {"requests": asked, "hits": self.hits, "misses": self.misses, "hit_rate": self.hits / asked if asked else 0.0}


def edit_similarity(a: str, b: str) -> float:
    """1 - Levenshtein distance / the longer length, as functions.text.similarity."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return 1 - row[-1] / max(len(a), len(b))


class Window:
    """Gives out times to begin at: at most `most` in any `seconds`."""

    def __init__(self, most: int, seconds: float, clock=time.monotonic) -> None:
        self.most, self.seconds, self.clock = most, seconds, clock
        self._given: deque[float] = deque(maxlen=most)
        self._lock = threading.Lock()

    def delay(self) -> float:
        """Seconds that a caller has to wait for its turn."""
        with self._lock:
            now = self.clock()
            turn = max(now, self._given[0] + self.seconds) if len(self._given) == self.most else now
            self._given.append(turn)
            return turn - now


class SharedWindow:
    """A window in the driver that the workers of all machines ask, so that its limit holds for all their calls together."""

    def __init__(self, most: int, seconds: float, host: str = "127.0.0.1") -> None:
        window = Window(most, seconds)

        class Answer(socketserver.StreamRequestHandler):
            def handle(self) -> None:
                self.wfile.write(f"{window.delay()!r}\n".encode())

        self._server = socketserver.ThreadingTCPServer((host, 0), Answer)
        self._server.daemon_threads = True
        threading.Thread(target=self._server.serve_forever, daemon=True).start()
        self.address = self._server.server_address

    def __getstate__(self) -> dict:
        return {"address": self.address}

    def delay(self) -> float:
        with socket.create_connection(self.address, timeout=60) as s:
            return float(s.makefile().readline())

    def close(self) -> None:
        self._server.shutdown()
        self._server.server_close()


class RateLimitedProvider:
    """Lets at most `most` calls begin in any `seconds`, of all types together; callers wait, each for its own turn.

    The limit is that of this process, or with a SharedWindow that of all who have it.
    """

    def __init__(self, inner: Provider, most: int = 5, seconds: float = 60.0, clock=time.monotonic, sleep=time.sleep, window: SharedWindow | None = None) -> None:
        self.inner, self.most, self.seconds, self.clock, self.sleep = inner, most, seconds, clock, sleep
        self.window = window or Window(most, seconds, clock)

    def __getstate__(self) -> dict:
        return self.__dict__ | ({"window": None} if isinstance(self.window, Window) else {})

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.window = self.window or Window(self.most, self.seconds, self.clock)

    def chat(self, prompt: str, request_type: str) -> Response:
        wait = self.window.delay()
        if wait > 0:
            self.sleep(wait)
        return self.inner.chat(prompt, request_type)


class HttpProvider:
    """A model behind a plain HTTP endpoint that takes and gives JSON in the common form of chat completions.

    Token numbers are those of the answer; whatever goes wrong is a failed call.
    """

    def __init__(self, url: str, model: str, headers: dict[str, str] | None = None, timeout: float = 120.0) -> None:
        self.url, self.model, self.headers, self.timeout = url, model, headers or {}, timeout

    def chat(self, prompt: str, request_type: str) -> Response:
        begun = time.monotonic()
        try:
            body = json.dumps({"model": self.model, "messages": [{"role": "user", "content": prompt}]}).encode()
            request = urllib.request.Request(self.url, body, {"Content-Type": "application/json"} | self.headers)
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                got = json.load(answer)
            used = got.get("usage") or {}
            text = got["choices"][0]["message"]["content"]
            return Response(text, int(used.get("prompt_tokens", 0)), int(used.get("completion_tokens", 0)), int((time.monotonic() - begun) * 1000))
        except Exception as e:
            return Response.failure(f"{type(e).__name__}: {e}")


def composed(base: Provider, cache_limits: dict | None = None, rate: tuple[int, float] | None = None, similar: bool = False, window: SharedWindow | None = None) -> Provider:
    """The base behind a rate limit behind a cache, so that kept answers don't count against the limit."""
    out = RateLimitedProvider(base, *(rate or ()), window=window) if rate or window else base
    return CachedProvider(out, cache_limits, similar) if cache_limits else out
