"""Commands: ``python -m ledgerloom ingest | ask | evaluate | sources``."""

from __future__ import annotations

import argparse
import importlib
import sys

from ledgerloom import pipeline
from ledgerloom.config import EngineConfig
from ledgerloom.operators import embed, memory, report
from ledgerloom.session import session
from ledgerloom.sources import registry
from ledgerloom.storage import scope


def _model(name: str | None) -> memory.Model | None:
    """A function of messages, named module:function; none for the extractive stand-in."""
    if not name:
        return None
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def shown(row, k: int, chunks: bool = True) -> str:
    """An answer as text: its state, the message, and what was found."""
    lines = [row.status + (f"  [{row.rule}]" if row.rule else "") + ":"]
    if row.rewritten:
        lines.append(f"  (resolved follow-up: {row.rewritten})")
    lines += ["", *row.message.splitlines(), ""]
    if row.link_url and row.status != "answered":
        lines += [row.link_url, ""]
    if chunks:
        lines.append(f"Retrieved chunks (top {k}), " + (f"narrowed by {row.narrowed_by}:" if row.narrowed_by else "whole corpus:"))
        if not row.chunks:
            lines.append("  (nothing was searched)")
        for i, c in enumerate(row.chunks, 1):
            lines += [f"  #{i}  chunk {c.chunk_index:>2}  {c.scheme or '':<12} {(c.section or '')[:34]}", f"      dense {c.dense_score:.4f}  lexical {c.lexical_score:.3f}", f"      {' '.join((c.text or '').split())[:110]}...", f"      {c.url or ''}"]
    return "\n".join(lines)


def _ask(spark, args) -> int:
    embedder, config = embed.backend(args.backend, args.model), EngineConfig(top_k=args.top_k)
    generator, rewriter = _model(args.generator), _model(args.rewriter)
    history: list[tuple[str, str]] = []

    def one(question: str):
        with scope(spark):
            return pipeline.ask(spark, args.root, [("1", question, history[-config.memory_messages :])], embedder, config, generator, rewriter).first()

    if args.one:
        row = one(args.one)
        print(shown(row, args.top_k, not args.no_chunks))
        return 2 if row.status in memory.NO_ANSWER else 0
    for line in sys.stdin:
        question = line.strip()
        if question.lower() in ("quit", "exit", ":q"):
            break
        if question:
            row = one(question)
            print(shown(row, args.top_k, not args.no_chunks), flush=True)
            # personal data enters no history, nor does an answer that failed
            if row.status != "refused_pii":
                history.append(("user", question))
            if row.status not in memory.NO_ANSWER:
                history.append(("assistant", row.message))
    return 0


def _ingest(spark, args) -> int:
    with scope(spark):
        try:
            built = pipeline.ingest(spark, args.root, None if args.no_store else embed.backend(args.backend, args.model), offline=args.offline, rebuild=args.rebuild, dump=not args.no_dump)
        except Exception as error:  # noqa: BLE001 - shown with a hint
            print(f"failed: {type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}", file=sys.stderr)
            print("without a network, run with --offline once clean texts are there", file=sys.stderr)
            return 1
        print(f"{'doc':<5}{'scheme':<15}{'sections':>10}{'kept':>7}{'words':>8}  title")
        for r in built.pages.toLocalIterator():
            print(f"{r.doc_id:<5}{r.scheme or '':<15}{r.sections:>10}{r.kept:>7}{r.words:>8,}  {(r.title or '')[:36]}")
        for r in report.per_scheme(built.chunks).orderBy("scheme").toLocalIterator():
            print(f"{r.scheme:<15}{r.n:>8}")
        s = report.sizes(built.chunks).first()
        print(f"chunk size   min={s.smallest}  mean={s.mean}  max={s.largest} words; {s.undersized} under size, {s.over_budget} over budget")
        if built.name:
            print(f"index        {built.name}, {built.count} vectors, of {built.snapshot}")
            if not args.no_preview:
                for r in report.preview(pipeline.store.open_index(spark, args.root, built.name)).collect():
                    print(f"[{r.chunk_index:03d}] " + " ".join(f"{x:+.6f}" for x in r.head) + f"  |v|^2 {r.square:.6f}  min {r.least:+.4f}  max {r.largest:+.4f}")
        print("seconds      " + ", ".join(f"{k} {v:.1f}" for k, v in built.seconds.items()) + f"; peak memory of the driver's Python {pipeline.peak_mb():.0f} MB")
    return 0


def _evaluate(spark, args) -> int:
    with scope(spark):
        rows = pipeline.evaluation(spark, args.root, embed.backend(args.backend, args.model), generator=_model(args.generator), unanswerable=tuple(args.unanswerable)).collect()
    for r in rows:
        print(f"{'ok  ' if r.ok else 'FAIL'} {r.metric:<28} {r.passed}/{r.total}")
    good = all(r.ok for r in rows)
    print("RESULT: " + ("PASS" if good else "FAIL"))
    return 0 if good else 1


def _sources(spark, args) -> int:
    rows = registry.read_csv(spark, f"{args.root}/sources.csv")
    print("| # | scheme | document | address | allowed |\n|---|---|---|---|---|")
    for r in registry.markdown(rows).toLocalIterator():
        print(r.line)
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="ledgerloom", description=__doc__)
    top.add_argument("--master")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, text: str, store: bool = True) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=text)
        p.add_argument("--root", required=True, help="folder of sources.csv, clean texts and indexes")
        if store:
            p.add_argument("--backend", choices=embed.BACKENDS, default="onnx")
            p.add_argument("--model", default="", help="folder or name of the encoder")
        p.set_defaults(run=run)
        return p

    p = command("ingest", _ingest, "sources to an index")
    for flag, text in (("--offline", "read clean texts instead of fetching"), ("--rebuild", "build anew and delete other indexes"), ("--no-dump", "write no review dump"), ("--no-store", "stop at the chunks"), ("--no-preview", "show no vectors")):
        p.add_argument(flag, action="store_true", help=text)
    p = command("ask", _ask, "answer questions, one or those of standard input")
    p.add_argument("--one")
    p.add_argument("--top-k", type=int, default=EngineConfig().top_k)
    p.add_argument("--no-chunks", action="store_true")
    p.add_argument("--generator", help="module:function of messages; without it answers are extractive")
    p.add_argument("--rewriter", help="module:function of messages")
    p = command("evaluate", _evaluate, "quality metrics as a gate")
    p.add_argument("--generator")
    p.add_argument("--unanswerable", type=int, nargs="*", default=[])
    command("sources", _sources, "the registry as a table", store=False)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(session(args.master), args)


if __name__ == "__main__":
    sys.exit(main())
