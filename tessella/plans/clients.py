"""Interfaces to embedding and chat services, with retries. Nothing here runs without a transport that the caller gives."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from email.utils import parsedate_to_datetime

ATTEMPTS, LONGEST_WAIT = 6, 60.0
MAX_CHARS = 2600


@dataclass
class Reply:
    status: int
    body: dict
    headers: Mapping[str, str]


#: Bytes of an embedding service's error, of a chat service's, and of a transcript's message that are kept.
EMBED_ERROR, CHAT_ERROR, TRANSCRIPT = 200, 1500, 1500


def cut(text: str, n: int) -> str:
    """The first n bytes of a text, without a character that they end in, and a mark if that isn't all."""
    raw = text.encode()
    return text if len(raw) <= n else raw[:n].decode(errors="ignore") + "…"


def transcript(messages) -> str:
    """A run as text: each message's role, the tools it calls, and its content cut to TRANSCRIPT."""
    calls = lambda m: "".join(f" -> {c.name} {c.args}" for c in m.calls)
    return "\n".join(f"{m.role}{calls(m)}: {cut(m.content, TRANSCRIPT)}" for m in messages)


class ServiceError(RuntimeError):
    def __init__(self, status: int, text: str, limit: int = CHAT_ERROR):
        super().__init__(f"status {status}: {cut(text, limit)}")
        self.status = status


class RefusedError(ServiceError):
    """The key is not accepted; trying again can't help."""


def wait_of(reply: Reply | None, attempt: int, base: float = 1.0, now: float | None = None) -> float:
    """Seconds before the next try: what the service asks for, else base * 2^attempt, a minute at most."""
    asked = reply.headers.get("Retry-After", "") if reply else ""
    try:
        return min(LONGEST_WAIT, max(0.0, float(asked)))
    except ValueError:
        pass
    try:
        return min(LONGEST_WAIT, max(0.0, parsedate_to_datetime(asked).timestamp() - (time.time() if now is None else now)))
    except (TypeError, ValueError):
        return min(LONGEST_WAIT, base * 2**attempt)


def retried(send: Callable[[], Reply], pause: Callable[[float], None] = time.sleep, tool_failures: int = 3, limit: int = CHAT_ERROR) -> dict:
    """The body of the first good reply. 429 and 5xx are tried again, failed tool uses a few times, all else is an error."""
    failed = 0
    for attempt in range(ATTEMPTS):
        reply = send()
        if reply.status == 200:
            return reply.body
        text = str(reply.body)
        if reply.status in (401, 403):
            raise RefusedError(reply.status, text, limit)
        if reply.status == 400 and "tool_use_failed" in text and failed < tool_failures:
            failed += 1
        elif reply.status != 429 and reply.status < 500:
            raise ServiceError(reply.status, text, limit)
        if attempt + 1 < ATTEMPTS:
            pause(wait_of(reply, attempt))
    raise ServiceError(reply.status, text, limit)


def batches(texts: list[str], max_items: int = 128, max_tokens: int = 100_000) -> list[list[str]]:
    """Texts in order within both limits, tokens estimated from bytes; a large text stands alone."""
    out: list[list[str]] = []
    size = 0
    for t in texts:
        n = len(t.encode()) // 4 + 1
        if not out or len(out[-1]) >= max_items or size + n > max_tokens:
            out.append([])
            size = 0
        out[-1].append(t)
        size += n
    return out


class HttpEmbedder:
    """`post(body)` gives a Reply whose data are {"index", "embedding"}; results keep the order of the texts."""

    def __init__(self, post: Callable[[dict], Reply], model: str, input_type: str | None = None, max_chars: int = MAX_CHARS, max_items: int = 128, max_tokens: int = 100_000, pause: Callable[[float], None] = time.sleep):
        self.post, self.model, self.input_type, self.max_chars, self.limits, self.pause = post, model, input_type, max_chars, (max_items, max_tokens), pause

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for part in batches([t[: self.max_chars] if self.max_chars > 0 else t for t in texts], *self.limits):
            body = {"model": self.model, "input": part} | ({"input_type": self.input_type} if self.input_type else {})
            data = sorted(retried(lambda body=body: self.post(body), self.pause, limit=EMBED_ERROR)["data"], key=lambda x: x["index"])
            if len(data) != len(part):
                raise ValueError(f"{len(data)} vectors for {len(part)} texts")
            out += [x["embedding"] for x in data]
        return out


def positive_numbers(name: str, default: tuple[int, ...] = (3000,), env: Mapping[str, str] = os.environ) -> tuple[int, ...]:
    """Positive whole numbers of a comma-separated variable."""
    got = tuple(n for x in env.get(name, "").split(",") if x.strip().lstrip("-").isdigit() and (n := int(x)) > 0)
    return got or default


def whole_number(name: str, default: int, env: Mapping[str, str] = os.environ) -> int:
    """A variable's whole number; the default where it is unset or none."""
    try:
        return int(env.get(name, "").strip())
    except ValueError:
        return default


def number(name: str, default: float, env: Mapping[str, str] = os.environ) -> float:
    try:
        return float(env.get(name, "").strip())
    except ValueError:
        return default


#: Service names and the variables that hold their keys.
PROVIDERS = {"voyage": "VOYAGE_API_KEY", "openai": "OPENAI_API_KEY"}


def embedder_from_env(post_to: Callable[[str, str], Callable[[dict], Reply]], input_type: str, env: Mapping[str, str] = os.environ) -> HttpEmbedder:
    """The embedder that EMBED_PROVIDER and EMBED_MODEL name; `post_to(provider, key)` gives the transport.

    Texts are cut to EMBED_MAX_CHARS only for services of the second kind, which know no input types.
    """
    provider = env.get("EMBED_PROVIDER", "voyage")
    if provider not in PROVIDERS:
        raise ValueError(f"unknown embedding provider {provider}")
    key = env.get(PROVIDERS[provider], "")
    if not key:
        raise ValueError(f"{PROVIDERS[provider]} is not set")
    typed = provider == "voyage"
    cut = 0 if typed else whole_number("EMBED_MAX_CHARS", MAX_CHARS, env)
    return HttpEmbedder(post_to(provider, key), env.get("EMBED_MODEL", ""), input_type if typed else None, cut)


class ChatClient:
    """A model behind a chat service; `post(body)` gives a Reply. Messages go without names, calls with their ids."""

    def __init__(self, post: Callable[[dict], Reply], model: str, pause: Callable[[float], None] = time.sleep):
        self.post, self.model, self.pause = post, model, pause

    def _ask(self, body: dict) -> dict:
        return retried(lambda: self.post({"model": self.model, "temperature": 0, **body}), self.pause)

    def generate(self, system: str, messages, tools: list[dict]):
        from .agent import Call, Message, Usage

        wire = [{"role": "system", "content": system}] if system else []
        for m in messages:
            calls = [{"id": c.id, "type": "function", "function": {"name": c.name, "arguments": c.args}} for c in m.calls]
            wire.append({"role": m.role, "content": m.content} | ({"tool_calls": calls} if calls else {}) | ({"tool_call_id": m.call_id} if m.role == "tool" else {}))
        body = self._ask({"messages": wire, "tools": [{"type": "function", "function": t} for t in tools]})
        got, used = body["choices"][0]["message"], body.get("usage") or {}
        calls = [Call(c["function"]["name"], c["function"].get("arguments") or "{}", c.get("id", "")) for c in got.get("tool_calls") or []]
        cached = (used.get("prompt_tokens_details") or {}).get("cached_tokens", 0)
        return Message("assistant", got.get("content") or "", calls), Usage(used.get("prompt_tokens", 0), used.get("completion_tokens", 0), cached)

    def summarize(self, text: str, instruction: str) -> str:
        body = self._ask({"messages": [{"role": "system", "content": instruction}, {"role": "user", "content": text}]})
        return (body["choices"][0]["message"].get("content") or "").strip()


GUIDELINE = """Shorten the observation. Keep its first line, every path and line number, names of functions and classes,
error messages and what was found out. Leave out what can be read again."""
RULES_HEADER = "Rules learned from failures:"


def load_guideline(path: str | None = None) -> str:
    """The file's text, or the built-in one; a file that is missing or empty is an error."""
    if not path:
        return GUIDELINE
    with open(path, encoding="utf-8") as f:
        text = f.read().strip()
    if not text:
        raise ValueError(f"{path} is empty")
    return text


def refined(guideline: str, pairs: list[tuple[str, str]], advise: Callable[[str, str], str]) -> str:
    """The guideline with a rule for each pair of transcripts (solved, failed after compression); `advise` may say NONE."""
    rules = [r for solved, failed in pairs if (r := advise(solved, failed).strip().split("\n")[0].strip()) and r.upper() != "NONE"]
    new = [f"- {r}" for r in dict.fromkeys(rules) if f"- {r}" not in guideline]
    if not new:
        return guideline
    head = [] if RULES_HEADER in guideline else ["", RULES_HEADER]
    return "\n".join([guideline.rstrip(), *head, *new]) + "\n"
