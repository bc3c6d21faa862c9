"""Command line: build a dataset, verify a dataset."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tessera.config import CACHE_DIRECTORY, FAIL_ON, BuildConfig, CacheConfig, ChunkConfig, DiscoveryConfig, ExportConfig, GenerationConfig, VerificationConfig, VerifierConfig
from tessera.errors import EngineError
from tessera.operators.clients import resolve_provider
from tessera.operators.judging import ACCEPTED, REJECTED, UNVERIFIABLE
from tessera.plans.build import BuildResult, build_dataset
from tessera.plans.verify import VerificationOutcome, fails_gate, verify_dataset
from tessera.progress import Event, describe


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera", description="Grounded question-and-answer datasets from Markdown repositories.")
    commands = top.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="generate a dataset")
    verify = commands.add_parser("verify", help="judge a dataset by its sources")
    for p, temperature in ((build, 0.2), (verify, 0.0)):
        p.add_argument("--repo", default=".")
        p.add_argument("--provider", choices=["ollama", "openai-compatible"], default="ollama")
        p.add_argument("--model")
        p.add_argument("--endpoint")
        p.add_argument("--api-key-env", default="OPENAI_API_KEY")
        p.add_argument("--api-key-file")
        p.add_argument("--prompt-file")
        p.add_argument("--temperature", type=float, default=temperature)
        p.add_argument("--concurrency", type=int, default=1)
        p.add_argument("--max-retries", type=int, default=2)
        p.add_argument("--cache-dir", default=CACHE_DIRECTORY)
        p.add_argument("--no-cache", action="store_true")
        p.add_argument("--parts", action="store_true", help="write a folder of part files, by tasks")
    build.add_argument("--out", default="dataset.jsonl")
    build.add_argument("--ignore-file", action="append", default=[], dest="ignore_files")
    build.add_argument("--max-files", type=int)
    build.add_argument("--max-bytes-per-file", type=int, default=1_000_000)
    build.add_argument("--max-characters", type=int, default=4_000)
    build.add_argument("--questions-per-chunk", type=int, default=3)
    build.add_argument("--no-gitignore", action="store_true")
    verify.add_argument("--dataset", default="dataset.jsonl")
    verify.add_argument("--manifest", default="manifest.json")
    verify.add_argument("--out", default="verification.jsonl")
    verify.add_argument("--fail-on", choices=FAIL_ON, default="never")
    return top


def provider_name(given: str) -> str:
    return "open_ai_compatible" if given == "openai-compatible" else given


def build_config(args: argparse.Namespace, model: str, endpoint: str | None) -> BuildConfig:
    return BuildConfig(
        args.repo, "docs", args.prompt_file, DiscoveryConfig(not args.no_gitignore, tuple(args.ignore_files), args.max_files, args.max_bytes_per_file), ChunkConfig(args.max_characters),
        GenerationConfig(provider_name(args.provider), model, endpoint, args.questions_per_chunk, args.temperature, args.concurrency, args.max_retries), ExportConfig("alpaca", args.out, args.parts), CacheConfig(not args.no_cache, args.cache_dir),
    )


def verification_config(args: argparse.Namespace, model: str, endpoint: str | None) -> VerificationConfig:
    return VerificationConfig(args.dataset, args.manifest, args.repo, args.out, args.prompt_file, VerifierConfig(provider_name(args.provider), model, endpoint, args.temperature, args.concurrency, args.max_retries), CacheConfig(not args.no_cache, args.cache_dir), args.parts)


def show(event: Event) -> None:
    print(describe(event), file=sys.stderr, flush=True)


def built(done: BuildResult) -> str:
    stats = done.manifest["stats"]
    lines = [f"{stats['generated_items']} items from {stats['chunks']} chunks of {stats['processed_files']} files in {done.output}", f"manifest in {done.manifest_path}"]
    left = [f"{stats[k]} {name}" for k, name in (("skipped_files", "files"), ("rejected_items", "rejected items"), ("duplicate_items", "repeated questions")) if stats[k]]
    return "\n".join(lines + ([f"left out: {', '.join(left)}"] if left else []))


def verified(done: VerificationOutcome) -> str:
    verdicts = ", ".join(f"{done.stats[f'{v}_items']} {v}" for v in (ACCEPTED, REJECTED, UNVERIFIABLE))
    return f"{done.stats['total_items']} items: {verdicts}\nreport in {done.output}\nmanifest in {done.manifest_path}"


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        model, endpoint, factory = resolve_provider(provider_name(args.provider), args.model, args.endpoint, args.api_key_file, args.api_key_env)
        spark = SparkSession.builder.appName("tessera").config("spark.speculation", "false").getOrCreate()
        if args.command == "build":
            done = build_dataset(spark, build_config(args, model, endpoint), factory, show)
            print(built(done))
            return 0
        outcome = verify_dataset(spark, verification_config(args, model, endpoint), factory, show)
        print(verified(outcome))
        return int(fails_gate(outcome.stats, args.fail_on))
    except EngineError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
