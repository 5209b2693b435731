"""python -m quillon: build, keep and ask an index from the command line. Answers are lines of JSON, or text, Markdown or places if asked."""

from __future__ import annotations

import argparse
import json
import sys
import time
from collections.abc import Sequence

from pyspark.sql import SparkSession

from quillon import formats
from quillon.operators import lookup, summary
from quillon.rpc import LIMIT, QueryLog, Server
from quillon.serve import Listener, stdio
from quillon.sources import modules
from quillon.sources.tree import Index, changed_since, count_by_kind, walk
from quillon.streaming.watch import watch

#: Verbs that ask; each takes one name, prefix, pattern or place.
QUESTIONS = ("def", "prefix", "fuzzy", "ref", "callers", "subclasses", "impact", "callgraph", "uses", "grep", "outline", "tldr", "coverage", "whereis", "owner")
#: The argument's key where it is not `name`.
KEYS = {"prefix": "prefix", "fuzzy": "query", "grep": "pattern", "outline": "path", "tldr": "path", "coverage": "path", "whereis": "path", "owner": "path"}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quillon", description=__doc__)
    out.add_argument("--index", required=True, help="folder of the index")
    out.add_argument("--log", help="file that questions are logged to")
    verbs = out.add_subparsers(dest="verb", required=True)
    for verb in QUESTIONS:
        one = verbs.add_parser(verb)
        one.add_argument("query", nargs="?" if verb == "coverage" else None, default="")
        for flag in ("--lang", "--kind", "--in", "--not-in", "--scope"):
            one.add_argument(flag)
        one.add_argument("--format", choices=("json", "text", "lines", "count", "paths", "by-def"), help="json (as it is without), text for people, PATH:LINE, or for uses and searches a count, paths, or counts by definition")
        for flag in ("--limit", "--depth", "--distance", "--max-nodes", "--budget", "--snippets"):
            one.add_argument(flag, type=int)
        one.add_argument("-i", "--case-insensitive", action="store_true", default=None)
        for flag, meaning in (("--regex", None), ("--reachable", "uses from modules that reach a definition"), ("--accumulate", "owner: of all folders above"), ("--fqn", "grep: with the symbol around each match"), ("--live", "grep: files as they are now")):
            one.add_argument(flag, action="store_true", default=None, help=meaning)
        one.add_argument("--md", action="store_true", help="answer in Markdown, with code where there are places")
    for verb in ("stats", "health", "compact"):
        verbs.add_parser(verb)
    verbs.add_parser("tombstone").add_argument("path")
    graph = verbs.add_parser("modules")
    graph.add_argument("kind", choices=("cargo", "soong", "kernel", "gn", "bazel"))
    graph.add_argument("root")
    graph.add_argument("--root-id", type=int, default=0)
    diff = verbs.add_parser("diff")
    diff.add_argument("root")
    diff.add_argument("--since", required=True, metavar="COMMIT")
    diff.add_argument("--root-id", type=int, default=0)
    diff.add_argument("--limit", type=int, default=50)
    verbs.add_parser("index-diff").add_argument("version", help="an earlier version of the index")
    for verb in ("index", "refresh", "count", "watch"):
        one = verbs.add_parser(verb)
        one.add_argument("roots", nargs="+", metavar="PROFILE=PATH", help="a tree and the profile of folders to skip")
        one.add_argument("--resolve", action="store_true", help="tie uses to definitions")
        one.add_argument("--no-trigrams", action="store_true")
        one.add_argument("--no-refs", action="store_true", help="index: keep no uses")
        one.add_argument("--limit", type=int, help="index, count: so many files of each tree, the first by path")
        one.add_argument("--skip", action="append", default=[], metavar="PATH", help="index: a file not to extract from")
        one.add_argument("--resume", action="store_true", help="index: go on with a run that was broken off")
        one.add_argument("--once", action="store_true", help="watch: stop when all that has changed is read")
        one.add_argument("--checkpoint", help="watch: folder of the stream's state")
    verbs.add_parser("completions").add_argument("shell", choices=("bash", "zsh", "fish"))
    verbs.add_parser("man", help="the manual page, as troff")
    serve = verbs.add_parser("serve")
    serve.add_argument("--listen", help="unix:PATH or tcp:HOST:PORT; otherwise standard input and output")
    serve.add_argument("--max-conns", type=int, default=0)
    serve.add_argument("--warm", action="store_true", help="cache the tables before the first question")
    return out


def _verbs() -> dict[str, argparse.ArgumentParser]:
    return next(a.choices for a in parser()._actions if isinstance(a, argparse._SubParsersAction))


def completions(shell: str) -> str:
    """A script that completes verbs and their options."""
    options = {verb: sorted(o for a in one._actions for o in a.option_strings if o.startswith("--")) for verb, one in _verbs().items()}
    if shell == "fish":
        lines = [f"complete -c quillon -n __fish_use_subcommand -a {verb}" for verb in options]
        return "\n".join(lines + [f"complete -c quillon -n '__fish_seen_subcommand_from {verb}' -l {o[2:]}" for verb, many in options.items() for o in many]) + "\n"
    cases = "\n".join(f'    {verb}) COMPREPLY=($(compgen -W "{" ".join(many)}" -- "$cur")); return;;' for verb, many in options.items())
    script = f"""_quillon() {{
  local cur="${{COMP_WORDS[COMP_CWORD]}}" word
  for word in "${{COMP_WORDS[@]:1:COMP_CWORD-1}}"; do
    case "$word" in
{cases}
    esac
  done
  COMPREPLY=($(compgen -W "--index --log {" ".join(options)}" -- "$cur"))
}}
complete -F _quillon quillon
"""
    return ("autoload -U +X bashcompinit && bashcompinit\n" if shell == "zsh" else "") + script


def manual() -> str:
    """The manual page, from the options' own help."""
    plain = lambda text: text.replace("\\", "\\e").replace("-", "\\-")
    out = [".TH QUILLON 1", ".SH NAME", "quillon \\- index source trees and ask them", ".SH SYNOPSIS", ".B quillon", "\\-\\-index FOLDER VERB ..."]
    for verb, one in _verbs().items():
        out += [f".SH {verb.upper()}", plain(" ".join(one.format_usage().split())), *(line for a in one._actions if a.option_strings and a.help for line in (".TP", plain(", ".join(a.option_strings)), plain(a.help)))]
    return "\n".join(out) + "\n"


def _roots(given: Sequence[str]) -> dict[str, str]:
    pairs = [g.partition("=") for g in given]
    if bad := [g for g, (_, sign, path) in zip(given, pairs, strict=True) if not sign or not path]:
        raise ValueError(f"not PROFILE=PATH: {', '.join(bad)}")
    return {path: profile for profile, _, path in pairs}


def _hints(index: Index, verb: str, args: dict, rows: list[dict]) -> list[str]:
    """Names near one that has no definition, or the folder that all rows of a full page share."""
    narrowed = any(k in args for k in ("lang", "kind", "in", "not_in", "scope"))
    if not rows and not narrowed and verb in ("def", "ref", "callers", "uses"):
        near = [r.name for r in lookup.did_you_mean(index.living("symbols"), args["name"]).collect()]
        return [f"Did you mean: {', '.join(near)}?"] if near else []
    paths = [r["path"] for r in rows if "path" in r]
    shared = lookup.narrow_hint(paths) if len(paths) > 1 and len(paths) == args.get("limit", LIMIT) and not narrowed else ""
    return [f"More may be left out; all of these are below {shared}"] if shared else []


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """Runs one verb; 0, or 1 after an error reply, or 2 if the index is not healthy."""
    own = vars(parser().parse_args(arguments))
    if own["verb"] in ("completions", "man"):
        print(completions(own["shell"]) if own["verb"] == "completions" else manual(), end="")
        return 0
    spark = spark or SparkSession.builder.appName("quillon").getOrCreate()
    index, verb = Index(spark, own["index"]), own["verb"]
    server = Server(index, QueryLog(own["log"]) if own["log"] else None)
    say = lambda x: print(json.dumps(x))
    if verb in (*QUESTIONS, "stats"):
        args = {k: v for k, v in own.items() if v is not None and k not in ("index", "log", "verb", "query", "budget", "md")}
        shape = args.pop("format") if own.get("format") in ("json", "text", "lines") and verb != "grep" or own.get("format") in ("json", "text") else None
        if verb != "stats":
            args[KEYS.get(verb, "name")] = own["query"]
        as_table = own.get("md")
        reply = next(server.request({"id": 1, "cmd": verb, "args": args, "budget": None if as_table else own.get("budget")}))
        if "error" in reply:
            print(reply["error"]["message"], file=sys.stderr)
            return 1
        rows = reply["result"] if isinstance(reply["result"], list) else [reply["result"]]
        if as_table and rows and "line" in rows[0] and "path" in rows[0]:
            print(formats.markdown(rows, server.read, own.get("budget")), end="")
        elif as_table:
            print(formats.table(rows, own.get("budget")))
        else:
            write = {"text": formats.as_text, "lines": formats.as_path_line}.get(shape or own.get("format"), json.dumps)
            for row in rows:
                print(write(row))
        for hint in _hints(index, verb, args, rows):
            print(hint, file=sys.stderr)
    elif verb == "serve":
        if own["warm"]:
            index.warm()
        if own["listen"]:
            Listener(server, own["listen"], own["max_conns"]).run()
        else:
            stdio(server)
    elif verb == "health":
        wrong = index.health()
        say({"healthy": not wrong, "wrong": wrong})
        return 2 if wrong else 0
    elif verb == "compact":
        say({"version": index.compact()})
    elif verb == "tombstone":
        say({"tombstones": index.tombstone(own["path"])})
    elif verb == "modules":
        try:
            graph = modules.of_index(index, own["kind"], own["root"], own["root_id"])
        except ValueError as e:
            print(e, file=sys.stderr)
            return 1
        say({"modules": index.attach(*graph.tables(spark), own["root_id"])})
    elif verb == "diff":
        changed = changed_since(spark, own["root"], own["since"], own["root_id"])
        for row in summary.changed_symbols(index.living("files"), index.living("symbols"), changed, own["limit"]).toJSON().collect():
            print(row)
    elif verb == "index-diff":
        for row in summary.index_diff(index.table("files", own["version"]), index.table("files")).where("status <> 'unchanged'").orderBy("root_id", "relpath").toJSON().toLocalIterator():
            print(row)
    else:
        roots, options = _roots(own["roots"]), {"resolve": own["resolve"], "trigrams": not own["no_trigrams"]}
        if verb == "count":
            rows = count_by_kind(walk(spark, roots, limit=own["limit"])).orderBy("lang").collect()
            for row in rows:
                say(row.asDict())
            print(f"{sum(r.files for r in rows)} files, {formats.human_bytes(sum(r.bytes for r in rows))}", file=sys.stderr)
        elif verb == "watch":
            watch(spark, index, roots, own["checkpoint"] or f"{own['index'].rstrip('/')}/watching", once=own["once"]).awaitTermination()
        else:
            began = time.time()
            if verb == "index":
                options |= {"limit": own["limit"], "references": not own["no_refs"], "skip": own["skip"], "resume": own["resume"]}
            say({"version": index.build(roots, **options) if verb == "index" else index.refresh(roots, **options)})
            print(f"done in {formats.eta(time.time() - began)}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
