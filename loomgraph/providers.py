"""Model interfaces, and deterministic implementations that need no network."""

from __future__ import annotations

import base64
import hashlib
import json
import os
import random
import re
import time
from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

from loomgraph.errors import MissingCredentials, ProviderFailure, TemplateMismatch


@dataclass
class TokenUsage:
    prompt: int = 0
    completion: int = 0

    def add(self, prompt: int, completion: int) -> None:
        self.prompt += prompt
        self.completion += completion

    @property
    def total(self) -> int:
        return self.prompt + self.completion


class LanguageModel(ABC):
    """Answers prompts. max_threads bounds the calls in flight: callers use as many partitions."""

    required_credentials: tuple[str, ...] = ()
    max_threads = 10

    def __init__(self):
        self.usage = TokenUsage()

    @abstractmethod
    def answer(self, prompt: str) -> str: ...

    def answer_json(self, prompt: str) -> str:
        return self.answer(prompt)

    def answer_in(self, prompt: str, schema: dict) -> str:
        """An answer in JSON of the given schema; a model without such a mode is told the schema."""
        return self.answer_json(f"{prompt}\n\nAnswer in JSON of this schema: {json.dumps(schema, sort_keys=True)}")

    def answer_about(self, prompt: str, image: bytes, kind: str = "image/png") -> str:
        """An answer about an image; models that see none raise ProviderFailure."""
        raise ProviderFailure("this model takes no images")


class Embedder(ABC):
    required_credentials: tuple[str, ...] = ()
    width: int

    @abstractmethod
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(ABC):
    required_credentials: tuple[str, ...] = ()

    @abstractmethod
    def score(self, query: str, text: str) -> float: ...

    def rerank(self, query: str, texts: list[str], top_n: int | None = None) -> list[tuple[int, float, str]]:
        """(index, score, text), best first; ties in the order given."""
        found = sorted(((i, self.score(query, t), t) for i, t in enumerate(texts)), key=lambda x: (-x[1], x[0]))
        return found if top_n is None else found[:top_n]


class Extractor(ABC):
    @abstractmethod
    def entities(self, text: str) -> tuple[list[tuple[str, str]], list[tuple[str, str, str]]]:
        """(name, description) of entities, and (source, target, relationship) of relations."""

    @abstractmethod
    def properties(self, text: str, names: list[str]) -> list[tuple[str, list[str]]]: ...

    @abstractmethod
    def keywords(self, text: str) -> list[str]: ...

    @abstractmethod
    def summary(self, text: str) -> str: ...


class Resolver(ABC):
    @abstractmethod
    def resolve(self, names: list[str]) -> list[tuple[str, list[str]]]:
        """(name, merged entities) for a set of names that look alike."""


class Summarizer(ABC):
    @abstractmethod
    def findings(self, text: str) -> tuple[str, str, list[str]]:
        """Title, summary and findings of a community's text."""


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


class HashedEmbedder(Embedder):
    """Signed counts of hashed character triples, of length one."""

    def __init__(self, width: int = 256):
        self.width = width

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for lo in range(0, len(texts), 256):
            out += self._block([f" {' '.join(words(t.replace(chr(10), ' ')))} " for t in texts[lo : lo + 256]]).tolist()
        return out

    def _block(self, texts: list[str]) -> np.ndarray:
        """Each distinct triple is hashed once, and looked up for all its places."""
        size = np.array([len(t) for t in texts])
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        key = code[:-2] << 42 | code[1:-1] << 21 | code[2:]
        end = np.cumsum(size)
        inside = np.ones(len(key), dtype=bool)  # a triple lies within one text
        for back in (1, 2):
            inside[(at := end - back)[(at >= 0) & (at < len(key))]] = False
        text = np.repeat(np.arange(len(texts)), size)[: len(key)][inside]
        triples, place = np.unique(key[inside], return_inverse=True)
        known = np.array([self._place(int(k)) for k in triples.tolist()], dtype=np.int64).reshape(-1, 2)
        v = np.bincount(text * self.width + known[place, 0], weights=known[place, 1], minlength=len(texts) * self.width).reshape(-1, self.width)
        norm = np.sqrt((v * v).sum(axis=1))
        return v / np.where(norm == 0, 1.0, norm)[:, None]

    def _place(self, key: int) -> tuple[int, int]:
        h = _triple_hash(key)
        return h % self.width, 1 if h >> 63 else -1


@lru_cache(maxsize=1 << 17)
def _triple_hash(key: int) -> int:
    triple = "".join(chr(key >> s & 0x1FFFFF) for s in (42, 21, 0))
    return int.from_bytes(hashlib.blake2b(triple.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class OverlapReranker(Reranker):
    """The share of the query's words that the text has."""

    def score(self, query: str, text: str) -> float:
        q = set(words(query))
        return len(q & set(words(text))) / len(q) if q else 0.0


class RuleExtractor(Extractor):
    """Entities are runs of capitalised words, relations are their meetings in a sentence, properties the sentences that name them."""

    _sentence = re.compile(r"[^.!?\n]+[.!?]?")
    _name = re.compile(r"\b[^\W\d_a-zà-ÿ][^\W\d_]+(?:\s[^\W\d_a-zà-ÿ][^\W\d_]+)*")

    def _sentences(self, text: str) -> list[str]:
        return [s.strip() for s in self._sentence.findall(text) if s.strip()]

    def entities(self, text):
        seen: dict[str, tuple[str, str]] = {}
        relations = []
        for s in self._sentences(text):
            own = list(dict.fromkeys(self._name.findall(s)))
            for n in own:
                seen.setdefault(n.lower(), (n, s))
            relations += [(a, b, s) for a, b in zip(own, own[1:])]
        return list(seen.values()), relations

    def properties(self, text, names):
        sentences = self._sentences(text)
        found = ((n, [s for s in sentences if n.lower() in s.lower()]) for n in names)
        return [(n, ps) for n, ps in found if ps]

    def keywords(self, text, top: int = 10):
        count: dict[str, int] = {}
        for w in words(text):
            if len(w) > 3:
                count[w] = count.get(w, 0) + 1
        return sorted(count, key=lambda w: (-count[w], w))[:top]

    def summary(self, text):
        first = self._sentences(text)[:3]
        if not first:
            raise ProviderFailure("a document without text has no summary")
        return " ".join(first)


class LongestNameResolver(Resolver):
    """All names of a set are the longest of them."""

    def resolve(self, names):
        best = max(sorted(names), key=len)
        return [(best, sorted(names))]


class FirstLinesSummarizer(Summarizer):
    def findings(self, text):
        lines = [x for x in text.split("\n") if x.strip()]
        names = list(dict.fromkeys(x.split(",")[0] for x in lines))
        return ", ".join(names[:3]), " ".join(lines[:3]), lines[:5]


class ContextAnswer(LanguageModel):
    """Gives back the context that a prompt holds after its last blank line."""

    def answer(self, prompt):
        out = prompt.rpartition("\n\n")[2].strip()
        self.usage.add(len(words(prompt)), len(words(out)))
        return out


def retried(call: Callable, attempts: int = 3, longest: float = 40.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """`call` tried again after random, doubling waits; the last failure is raised."""

    def run(*args, **more):
        for i in range(attempts):
            try:
                return call(*args, **more)
            except Exception:
                if i == attempts - 1:
                    raise
                sleep(random.uniform(0, min(longest, 2.0**i)))

    return run


def message(role: str, text: str, image: bytes | None = None, kind: str = "image/png") -> dict:
    """A chat message of a text, with an image as a data URL where there is one."""
    if image is None:
        return {"role": role, "content": text}
    url = f"data:{kind};base64,{base64.b64encode(image).decode()}"
    return {"role": role, "content": [{"type": "text", "text": text}, {"type": "image_url", "image_url": {"url": url}}]}


@dataclass(frozen=True)
class Parameter:
    """A parameter of a tool: one of `choices` where there are any."""

    name: str
    kind: str
    description: str
    choices: tuple[str, ...] = ()
    required: bool = True

    def schema(self) -> dict:
        return {"type": self.kind, "description": self.description} | ({"enum": list(self.choices)} if self.choices else {})


@dataclass(frozen=True)
class Function:
    """A tool that a model may call."""

    name: str
    description: str
    parameters: tuple[Parameter, ...] = ()

    def schema(self) -> dict:
        own = {"type": "object", "properties": {p.name: p.schema() for p in self.parameters}, "required": [p.name for p in self.parameters if p.required]}
        return {"type": "function", "function": {"name": self.name, "description": self.description, "parameters": own}}


@dataclass(frozen=True)
class FunctionCall:
    """A call that a model asked for; `arguments` is its JSON."""

    name: str
    arguments: str

    def values(self) -> dict:
        return json.loads(self.arguments)


_VARIABLE = re.compile(r"\{\{\s*(\w+)\s*\}\}")

TEMPLATES = {
    "entities": "Name the entities of the text, with a description of each, and how they relate. Answer in JSON.\n\n{{ text }}",
    "properties": "For each of these entities, list what the text says of it: {{ names }}. Answer in JSON.\n\n{{ text }}",
    "keywords": "List keywords of this document in JSON.\n\n{{ text }}",
    "summary": "Sum up this document.\n\n{{ text }}",
    "table": "Name what this table is about (mark it as the main node) and its entities. Answer in JSON.\n\n{{ text }}",
    "figure": "Name what this figure shows (mark it as the main node) and its entities. Answer in JSON.\n\n{{ caption }}",
    "merge": "Which of these names mean the same? Answer in JSON.\n\n{{ names }}",
    "community": "Give this community a title, a summary and findings, in JSON.\n\n{{ text }}",
    "local": "Answer the question from the context.\nQuestion: {{ query }}\n\n{{ context }}",
    "global": "Answer the question from these findings about the whole.\nQuestion: {{ query }}\n\n{{ context }}",
}


def variables(template: str) -> set[str]:
    return set(_VARIABLE.findall(template))


def fill(template: str, values: dict[str, str]) -> str:
    """The template with its variables replaced; the names given must be those of the template."""
    if variables(template) != set(values):
        raise TemplateMismatch(f"template has {sorted(variables(template))}, given are {sorted(values)}")
    return _VARIABLE.sub(lambda m: str(values[m[1]]), template)


@dataclass
class Providers:
    """All models of a graph."""

    model: LanguageModel = field(default_factory=ContextAnswer)
    embedder: Embedder = field(default_factory=HashedEmbedder)
    reranker: Reranker = field(default_factory=OverlapReranker)
    extractor: Extractor = field(default_factory=RuleExtractor)
    resolver: Resolver = field(default_factory=LongestNameResolver)
    summarizer: Summarizer = field(default_factory=FirstLinesSummarizer)

    def check_credentials(self, given: dict[str, str]) -> None:
        need = {c for p in (self.model, self.embedder, self.reranker) for c in p.required_credentials}
        missing = sorted(c for c in need if c not in given and c not in os.environ)
        if missing:
            raise MissingCredentials(", ".join(missing))


_EMBEDDERS: dict[str, Callable[[], Embedder]] = {"hashed": HashedEmbedder}


def embedder(kind: str | None = None) -> Embedder:
    """The embedder of a kind, or of the kind that LOOMGRAPH_EMBEDDER names."""
    kind = kind or os.environ.get("LOOMGRAPH_EMBEDDER", "hashed")
    if kind not in _EMBEDDERS:
        raise ValueError(f"unknown embedder {kind}")
    return _EMBEDDERS[kind]()
