"""Requests as plain data: one object in, one reply or a stream of replies out.

A request is {"id", "cmd", "args", "stream"?, "budget"?}. Verbs are run on one
index, over one Spark session.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.formats import snippet
from quillon.operators import graph, grep, lookup, refs, summary
from quillon.sources.tree import Index

LIMIT = 50
TRIMMED = ("snippet", "scope_path", "fqn_index", "fqn_live")


def trimmed(rows: list[dict], budget: int) -> list[dict]:
    """Rows that fit so many bytes of JSON: optional fields go first, then rows from the end."""
    size = lambda r: len(json.dumps(r))
    for key in TRIMMED:
        if size(rows) <= budget:
            break
        rows = [{k: v for k, v in r.items() if k != key} for r in rows]
    while rows and size(rows) > budget:
        rows = rows[:-1]
    return rows


def fitted(row: dict, budget: int) -> dict:
    """A row of a stream without as many optional fields as it takes to fit so many bytes of JSON."""
    for key in TRIMMED:
        if len(json.dumps(row)) <= budget:
            break
        row = {k: v for k, v in row.items() if k != key}
    return row


class QueryLog:
    """Lines of JSON at the end of a file of the driver. Above max_bytes (0: never) the file is moved to NAME.1 and begun anew."""

    def __init__(self, path: str, max_bytes: int = 100 << 20):
        self.path, self.max_bytes = path, max_bytes
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)

    def append(self, entry: dict) -> None:
        if self.max_bytes and os.path.exists(self.path) and os.path.getsize(self.path) > self.max_bytes:
            os.replace(self.path, f"{self.path}.1")
        with open(self.path, "a", encoding="utf-8") as file:
            file.write(json.dumps(entry) + "\n")


class Server:
    def __init__(self, index: Index, log: list[dict] | QueryLog | None = None):
        self.index, self.log = index, log if log is not None else []
        self._files: tuple[str | None, int] | None = None

    def request(self, line: str | dict) -> Iterator[dict]:
        """The replies to a request: one, or with `stream` one for each hit and one at the end."""
        try:
            message = json.loads(line) if isinstance(line, str) else line
        except ValueError as e:
            yield {"id": None, "error": {"code": -32700, "message": f"parse error: {e}"}}
            return
        own, args = message.get("id"), message.get("args") or {}
        verb = getattr(self, f"do_{message.get('cmd')}", None)
        if verb is None:
            yield {"id": own, "error": {"code": -32601, "message": f"unknown command: {message.get('cmd')}"}}
            return
        began = time.time()
        try:
            result = verb(args)
        except (KeyError, ValueError) as e:
            yield {"id": own, "error": {"code": -32602, "message": str(e)}}
            return
        rows = [json.loads(x) for x in result.toJSON().collect()] if isinstance(result, DataFrame) else result
        hits, budget, streamed = len(rows) if isinstance(rows, list) else 1, int(message.get("budget") or 0), bool(message.get("stream"))
        if isinstance(rows, list) and budget:
            rows = [fitted(r, budget) for r in rows] if streamed else trimmed(rows, budget)
        entry = {"ts": int(began), "cmd": message["cmd"], "query": self._name(args), "hits": hits, "shown": len(rows) if isinstance(rows, list) else 1}
        self.log.append(entry | {"files_total": self._total(), "elapsed_ms": int(1000 * (time.time() - began)), "index": self.index.folder, "version": self.index.version(), "pid": os.getpid()})
        if streamed and isinstance(rows, list):
            for row in rows:
                yield {"id": own, "hit": row}
            yield {"id": own, "done": True, "shown": len(rows)}
        else:
            yield {"id": own, "result": rows}

    def serve(self, lines: Iterable[str]) -> Iterator[str]:
        for line in filter(str.strip, lines):
            for reply in self.request(line):
                yield json.dumps(reply)

    @staticmethod
    def _name(args: dict) -> str:
        return next((args[k] for k in ("name", "prefix", "query", "pattern", "path") if k in args), "")

    def _total(self) -> int:
        """The number of files of the current version, counted once."""
        version = self.index.version()
        if self._files is None or self._files[0] != version:
            self._files = (version, self.index.table("files").count())
        return self._files[1]

    def _filters(self, args: dict) -> dict:
        return {"inside": args.get("in"), "outside": args.get("not_in"), "limit": int(args.get("limit", LIMIT))}

    def _symbols(self) -> DataFrame:
        return self.index.living("symbols")

    def _refs(self, args: dict) -> DataFrame:
        """The uses; with `reachable` those from whose module a definition of the name can be reached, if the index has a module graph."""
        found = self.index.living("refs")
        known = self.index.modules() if args.get("reachable") else None
        return graph.reachable(found, args["name"], self._symbols(), *known) if known else found

    def do_def(self, args: dict) -> DataFrame:
        return lookup.definitions(self._symbols(), args["name"], args.get("lang"), args.get("kind"), every_package=True, **self._filters(args))

    def do_prefix(self, args: dict) -> DataFrame:
        return lookup.by_prefix(self._symbols(), self._name(args), **self._filters(args))

    def do_fuzzy(self, args: dict) -> DataFrame:
        return lookup.fuzzy(self._symbols(), self._name(args), int(args.get("distance", 2)), **self._filters(args))

    def do_ref(self, args: dict) -> DataFrame:
        found = refs.find(self._refs(args), args["name"], args.get("kind"), args.get("lang"), args.get("scope"), args.get("in"), args.get("not_in"))
        form, limit = args.get("format"), int(args.get("limit", LIMIT))
        if form == "count":
            return found.agg(F.count("*").alias("count"))
        if form == "paths":
            return refs.paths(found, limit)
        if form == "by-def":
            return refs.by_definition(found, self._symbols(), limit)
        return found.limit(limit)

    def do_callers(self, args: dict) -> DataFrame:
        return self.do_ref(args | {"kind": "call"})

    def do_subclasses(self, args: dict) -> DataFrame:
        return graph.subclasses(self._refs({}), self._symbols(), args["name"], int(args.get("depth", 0))).limit(int(args.get("limit", LIMIT)))

    def do_impact(self, args: dict) -> DataFrame:
        return graph.impact(self._refs(args), self._symbols(), args["name"], int(args.get("depth", 2)), self._refs({})).orderBy("path").limit(int(args.get("limit", LIMIT)))

    def do_callgraph(self, args: dict) -> DataFrame:
        return graph.callgraph(self._refs(args), self._symbols(), args["name"], int(args.get("depth", 3)), int(args.get("max_nodes", 200)), args.get("in"), args.get("not_in"))

    def do_uses(self, args: dict) -> DataFrame:
        return refs.uses(self.index.living("refs_by_file"), self.index.living("symbols_by_file"), args["name"], args.get("kind")).orderBy("path", "line", "col").limit(int(args.get("limit", LIMIT)))

    def do_grep(self, args: dict) -> DataFrame:
        """With `fqn` each match has the symbol around it; formats `count` and `lines`; `live` searches files as they are now."""
        postings = None if args.get("live") else self.index.postings()
        options = self._filters(args)
        counted = args.get("format") == "count"
        found = grep.search(
            self.index.texts(bool(args.get("live"))), self._name(args), bool(args.get("case_insensitive")), args.get("regex"), args.get("lang"),
            postings=postings, per_file=None if counted else 16, **(options | {"limit": None} if counted else options),
        )
        if counted:
            return grep.counts(found)
        if args.get("fqn"):
            found = lookup.enclosed(found, self.index.living("symbols_by_file")).orderBy("path", "byte")
        return found.select("path", "line") if args.get("format") == "lines" else found

    def _file(self, args: dict) -> str:
        found = lookup.resolve_path(self.index.living("files"), self._name(args)).collect()
        if not found:
            raise ValueError(f"no file {self._name(args)}")
        return found[0].path

    def do_outline(self, args: dict) -> DataFrame | list[dict]:
        """With `snippets` each symbol has so many lines of code from its place on, as they are now."""
        path = self._file(args)
        rows = summary.outline(self.index.living("symbols_by_file"), path, int(args.get("limit", LIMIT)))
        if not (number := int(args.get("snippets", 0))):
            return rows
        text = self.read(path)
        return [r | {"snippet": snippet(text, r["line"], number)} for r in (json.loads(x) for x in rows.toJSON().collect())]

    def read(self, path: str) -> str | None:
        """What a file holds now; what it held when it was indexed, if it is gone."""
        if (text := self.index.live_text(path)) is not None:
            return text
        row = self.index.texts().where(F.col("path") == path).first()
        return row.text if row else None

    def do_tldr(self, args: dict) -> dict:
        path = self._file(args)
        own = self.index.living("symbols_by_file").where(F.col("path") == path)
        first = next((x.strip() for x in (self.read(path) or "").split("\n") if x.strip()), "")
        kinds = {r.kind: r.n for r in summary.kinds(own).orderBy("kind").collect()}
        return {"path": path, "total": sum(kinds.values()), "kinds": kinds, "top": [r.name for r in summary.best_of_each(own).orderBy("place").collect()], "first": first}

    def do_coverage(self, args: dict) -> DataFrame:
        return summary.coverage(self.index.living("files"), self._symbols(), self._name(args))

    def do_stats(self, args: dict) -> dict:
        return {
            "files": self.index.living("files").count(), "symbols": self._symbols().count(), "refs": self._refs({}).count(), "version": self.index.version(),
            "by_lang": {r.lang: r.n for r in summary.languages(self._symbols()).orderBy("lang").collect()}, "by_kind": {r.kind: r.n for r in summary.kinds(self._symbols()).orderBy("kind").collect()},
        }

    def do_owner(self, args: dict) -> DataFrame:
        self._file(args)
        return self.index.owners(self._name(args), "all" if args.get("accumulate") else "nearest")

    def do_whereis(self, args: dict) -> DataFrame:
        path, byte, line, col = lookup.parse_place(self._name(args))
        own = lookup.resolve_path(self.index.living("files"), path).select("file_id", "path", "lang").collect()
        if not own:
            raise ValueError(f"no file {path}")
        if byte is None:  # lines as the file has them now
            text = self.index.spark.createDataFrame([(*own[0], self.read(own[0].path))], "file_id long, path string, lang string, text string")
            places = lookup.byte_of(grep.lines(text), line, col)
        else:
            places = self.index.spark.createDataFrame([(own[0].file_id, byte)], "file_id long, byte long")
        return lookup.whereis(self.index.living("symbols_by_file"), places, ("name", "kind", "fqn_live", "line", "span_start", "span_end"))
