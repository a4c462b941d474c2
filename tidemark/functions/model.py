"""The model behind semantic operators: a protocol, an offline rule model, prompt packing and reply parsing."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Protocol


@dataclass(frozen=True)
class Request:
    """One task: what is asked, about which values; ``kind`` tells the reply's shape."""

    kind: str
    instruction: str
    values: Mapping

    @property
    def prompt(self) -> str:
        return render(self.instruction, self.values)


class Model(Protocol):
    def answer(self, requests: Sequence[Request]) -> list[str]:
        """Reply texts, one for each request. Instances are pickled to the executors."""


PLACE = re.compile(r"\{([^{}]+)\}")


def placeholders(instruction: str) -> list[str]:
    return list(dict.fromkeys(PLACE.findall(instruction)))


def render(instruction: str, values: Mapping) -> str:
    def put(m: re.Match) -> str:
        if m[1] not in values:
            raise ValueError(f"unknown placeholder {m[1]}")
        return str(values[m[1]])

    return PLACE.sub(put, instruction)


@dataclass(frozen=True)
class SameKey:
    """A rule for a question about two sides that says yes exactly where ``key`` gives both the same. It answers pairs as
    any rule does; an operator that finds it asks each side for its key instead, one question for each value, and
    joins on the keys, which gives the same pairs."""

    key: Callable[[Mapping], object]

    def __call__(self, values: Mapping) -> bool:
        sides: dict[str, dict] = {}
        for name, v in values.items():
            column, _, side = name.rpartition(":")
            sides.setdefault(side, {})[column] = v
        left, right = sides.values()
        return self.of(left) == self.of(right)

    def of(self, values: Mapping) -> str:
        """The key as text; keys are the same where their texts are."""
        return json.dumps(self.key(values), ensure_ascii=False, sort_keys=True, default=str)


def keyed(model, instruction: str) -> bool:
    """Whether the model can say a key of one side in place of answers about pairs. Only the model itself is asked, not
    one that it wraps, which may answer differently."""
    return isinstance(model, RuleModel | TextModel) and isinstance(model.rules.get(instruction), SameKey)


@dataclass
class RuleModel:
    """Deterministic: a Python rule for each instruction, applied to the task's values."""

    rules: Mapping[str, Callable[[Mapping], object]]
    calls: int = field(default=0, compare=False)

    def answer(self, requests: Sequence[Request]) -> list[str]:
        self.calls += len(requests)
        out = []
        for r in requests:
            if r.instruction not in self.rules:
                raise KeyError(f"no rule for {r.instruction!r}")
            rule = self.rules[r.instruction]
            out.append(rule.of(r.values) if r.kind == "key" else json.dumps(rule(r.values), ensure_ascii=False, default=str))
        return out


class ReplyError(ValueError):
    pass


def _read_json(body: str):
    """JSON, possibly with trailing commas or missing closers."""
    try:
        return json.loads(body)
    except json.JSONDecodeError:
        pass
    smaller = re.sub(r",\s*([\]}])", r"\1", body)
    stack, quoted, escaped = [], False, False
    for ch in smaller:
        if quoted:
            escaped, quoted = ch == "\\" and not escaped, not (ch == '"' and not escaped)
        elif ch == '"':
            quoted = True
        elif ch in "[{":
            stack.append("]" if ch == "[" else "}")
        elif ch in "]}" and stack and stack[-1] == ch:
            stack.pop()
    try:
        return json.loads(smaller + '"' * quoted + "".join(reversed(stack)))
    except json.JSONDecodeError as e:
        raise ReplyError(f"no JSON in reply: {body[:80]!r}") from e


def parse_reply(text: str):
    """The JSON value of a reply. Of fenced blocks that hold JSON all must say the same."""
    fenced = re.findall(r"```(?:json)?\s*(.*?)```", text, re.S)
    if not fenced:
        return _read_json(text.strip())
    found = []
    for body in fenced:
        try:
            found.append(_read_json(body.strip()))
        except ReplyError:
            continue
    if not found or any(x != found[0] for x in found):
        raise ReplyError("the reply's blocks have no or several readings")
    return found[0]


SCALARS = (str, int, float, bool, type(None))


YES, NO = frozenset(("true", "yes")), frozenset(("false", "no"))


def check_keep(reply, default: bool | None = None) -> bool:
    """A decision of a parsed reply or of plain text; ``default`` where it decides nothing, None: an error."""
    if isinstance(reply, Mapping):
        reply = reply.get("keep")
    if isinstance(reply, bool):
        return reply
    if isinstance(reply, str):
        said = {w.lower() for w in re.findall(r"[^\W\d_]+", reply)}
        if bool(said & YES) != bool(said & NO):
            return bool(said & YES)
    if default is None:
        raise ReplyError("the reply is not a boolean")
    return default


def check_record(reply, outputs: Sequence[str]) -> dict:
    if not isinstance(reply, Mapping):
        if len(outputs) != 1:
            raise ReplyError("an object is needed")
        reply = {outputs[0]: reply}
    if set(reply) != set(outputs) or not all(isinstance(v, SCALARS) for v in reply.values()):
        raise ReplyError(f"exactly the scalars {list(outputs)} are needed")
    return {k: None if v is None else v if isinstance(v, str) else json.dumps(v) for k, v in reply.items()}


def check_rows(reply, outputs: Sequence[str]) -> list[dict]:
    rows = reply.get("rows") if isinstance(reply, Mapping) else reply
    if not isinstance(rows, list):
        raise ReplyError("a list of rows is needed")
    return [check_record(r, outputs) for r in rows]


# Readers: what an operator makes of a reply's text


def reads_keep(default: bool | None) -> Callable[[str], bool]:
    """Yes or no, as JSON or plain text; with a default no text is an error."""

    def read(text: str) -> bool:
        try:
            reply = parse_reply(text)
        except ReplyError:
            reply = text
        return check_keep(reply if isinstance(reply, bool | str | Mapping) else text, default)

    return read


def reads_record(outputs: Sequence[str]) -> Callable[[str], dict]:
    """Several outputs are strict JSON. A single one is the reply's text, unless that is JSON of the one output."""

    def read(text: str) -> dict:
        if len(outputs) > 1:
            return check_record(parse_reply(text), outputs)
        try:
            reply = parse_reply(text)
            if isinstance(reply, Mapping) or isinstance(reply, SCALARS):
                return check_record(reply, outputs)
        except ReplyError:
            pass
        return {outputs[0]: text.strip()}

    return read


def reads_text(text: str) -> str | None:
    return reads_record(("text",))(text)["text"]


def reads_rows(outputs: Sequence[str]) -> Callable[[str], list[dict]]:
    return lambda text: check_rows(parse_reply(text), outputs)


def reads_label(labels: Sequence[str]) -> Callable[[str], str]:
    def read(text: str) -> str:
        said = reads_record(("label",))(text)["label"]
        found = [x for x in labels if said is not None and x.lower() == said.strip(" .\n\"'").lower()]
        if not found:
            raise ReplyError(f"undeclared label {said!r}")
        return said if said in labels else found[0]

    return read


def reads_ids(n: int, least: int, most: int) -> Callable[[str], list[int]]:
    """From ``least`` to ``most`` unique ids below ``n``."""

    def read(text: str) -> list[int]:
        reply = parse_reply(text)
        reply = reply.get("selected_ids") if isinstance(reply, Mapping) else reply
        if not isinstance(reply, list) or not all(type(x) is int for x in reply):
            raise ReplyError("a list of ids is needed")
        if not least <= len(reply) <= most or len(set(reply)) != len(reply) or not set(reply) <= set(range(n)):
            raise ReplyError("the ids repeat, are unknown, too few or too many")
        return reply

    return read


def ask(model: Model, requests: Sequence[Request], read: Callable[[str], object], retries: int = 3, batch: int = 64) -> list:
    """What ``read`` makes of the replies, in order; only tasks whose reply fails are asked again."""
    out: list = [None] * len(requests)
    todo = list(range(len(requests)))
    for attempt in range(retries + 1):
        failed: list[int] = []
        for at in range(0, len(todo), batch):
            part = todo[at : at + batch]
            for i, text in zip(part, model.answer([requests[i] for i in part]), strict=True):
                try:
                    out[i] = read(text)
                except ReplyError:
                    if attempt == retries:
                        raise
                    failed.append(i)
        if not failed:
            break
        todo = failed
    return out


@dataclass
class TextModel:
    """Rules that answer as a text model does: booleans as words, single values as bare text, the rest as JSON."""

    rules: Mapping[str, Callable[[Mapping], object]]

    def answer(self, requests: Sequence[Request]) -> list[str]:
        out = []
        for r in requests:
            said = self.rules[r.instruction].of(r.values) if r.kind == "key" else self.rules[r.instruction](r.values)
            out.append(said if isinstance(said, str) else str(said) if isinstance(said, bool | int | float) else json.dumps(said, ensure_ascii=False, default=str))
        return out


@dataclass
class PackedModel:
    """Packs up to ``size`` tasks in one prompt of an inner text model; replies must cover exactly the ids."""

    inner: Callable[[str], str]
    size: int = 8
    retries: int = 3

    def answer(self, requests: Sequence[Request]) -> list[str]:
        out: list[str] = []
        for at in range(0, len(requests), self.size):
            part = requests[at : at + self.size]
            prompt = json.dumps({"tasks": [{"id": i, "kind": r.kind, "task": r.prompt} for i, r in enumerate(part)]}, ensure_ascii=False)
            for attempt in range(self.retries + 1):
                try:
                    got = parse_reply(self.inner(prompt))
                    found = {x["id"]: x["result"] for x in got["results"]}
                    if set(found) != set(range(len(part))) or len(got["results"]) != len(part):
                        raise ReplyError("the ids of the reply differ")
                    break
                except (ReplyError, KeyError, TypeError):
                    if attempt == self.retries:
                        raise ReplyError("a packed reply stayed unusable") from None
            out += [json.dumps(found[i], ensure_ascii=False) for i in range(len(part))]
        return out


@dataclass
class CascadeModel:
    """A cheap score decides clear cases of yes/no tasks: from ``high`` on yes, up to ``low`` no; the rest is asked."""

    oracle: Model
    proxy: Callable[[Mapping], float]
    low: float
    high: float

    def answer(self, requests: Sequence[Request]) -> list[str]:
        out: list[str | None] = []
        for r in requests:
            score = self.proxy(r.values) if r.kind in ("filter", "join", "same") else None
            out.append(None if score is None or self.low < score < self.high else json.dumps(score >= self.high))
        rest = [i for i, x in enumerate(out) if x is None]
        for i, text in zip(rest, self.oracle.answer([requests[i] for i in rest]) if rest else [], strict=True):
            out[i] = text
        return out


@dataclass
class PairwiseModel:
    """Answers ranking tasks by comparisons of two items; ``method`` is ``naive`` (all pairs, most wins),
    ``quick`` (quickselect, then sort) or ``heap``. Other tasks go to the inner model unchanged."""

    inner: Model
    method: str = "heap"

    def _better(self, request: Request, a: Mapping, b: Mapping) -> bool:
        values = {"query": request.values["query"], "a": a, "b": b}
        return ask(self.inner, [Request("compare", request.instruction, values)], reads_keep(None))[0]

    def answer(self, requests: Sequence[Request]) -> list[str]:
        out = []
        for r in requests:
            if r.kind != "rank":
                out += self.inner.answer([r])
                continue
            items, k = list(r.values["items"]), r.values["k"]
            order = {"naive": self._naive, "quick": self._quick, "heap": self._heap}[self.method](r, items, k)
            out.append(json.dumps([x["id"] for x in order]))
        return out

    def _naive(self, r: Request, items: list, k: int) -> list:
        wins = {x["id"]: 0 for x in items}
        for i, a in enumerate(items):
            for b in items[i + 1 :]:
                wins[(a if self._better(r, a, b) else b)["id"]] += 1
        return sorted(items, key=lambda x: -wins[x["id"]])[:k]

    def _quick(self, r: Request, items: list, k: int) -> list:
        if len(items) <= 1 or k <= 0:
            return items[: max(k, 0)]
        pivot, rest = items[0], items[1:]
        above = [x for x in rest if self._better(r, x, pivot)]
        if len(above) >= k:
            return self._quick(r, above, k)
        below = [x for x in rest if x not in above]
        return [*self._quick(r, above, len(above)), pivot, *self._quick(r, below, k - len(above) - 1)][:k]

    def _heap(self, r: Request, items: list, k: int) -> list:
        import heapq
        from functools import cmp_to_key

        key = cmp_to_key(lambda a, b: -1 if self._better(r, a, b) else 1)
        return heapq.nsmallest(k, items, key=key)


@dataclass
class CachedModel:
    """Keeps replies by (kind, instruction, values) within a worker, up to ``most``."""

    inner: Model
    most: int = 100_000
    known: dict = field(default_factory=dict)

    def answer(self, requests: Sequence[Request]) -> list[str]:
        keys = [json.dumps([r.kind, r.instruction, dict(r.values)], sort_keys=True, default=str) for r in requests]
        new = {k: r for k, r in zip(keys, requests, strict=True) if k not in self.known}
        if len(self.known) + len(new) > self.most:
            kept = {k: self.known[k] for k in keys if k in self.known}
            self.known = kept
        for k, text in zip(new, self.inner.answer(list(new.values())) if new else [], strict=True):
            self.known[k] = text
        return [self.known[k] for k in keys]
