"""API keys: the environment first, then a file only its owner reads; and a small command for it."""

from __future__ import annotations

import argparse
import getpass
import json
import os
from pathlib import Path

# Providers and their environment variables.
PROVIDERS = {"openai": "OPENAI_API_KEY", "anthropic": "ANTHROPIC_API_KEY", "google": "GOOGLE_API_KEY", "ollama": ""}


def store() -> Path:
    return Path(os.getenv("MILLRACE_HOME", Path.home() / ".millrace")) / "config.json"


def load() -> dict:
    return json.loads(store().read_text(encoding="utf-8")) if store().exists() else {}


def save(settings: dict) -> None:
    store().parent.mkdir(parents=True, exist_ok=True)
    store().write_text(json.dumps(settings, indent=2), encoding="utf-8")
    store().chmod(0o600)


def _known(provider: str) -> None:
    if provider not in PROVIDERS:
        raise ValueError(f"Unknown provider: {provider}. Valid providers: {', '.join(PROVIDERS)}")


def set_api_key(provider: str, key: str) -> None:
    _known(provider)
    settings = load()
    settings.setdefault("api_keys", {})[provider] = key
    save(settings)


def get_api_key(provider: str) -> str | None:
    return (os.getenv(PROVIDERS.get(provider) or "") if PROVIDERS.get(provider) else None) or load().get("api_keys", {}).get(provider)


def remove_api_key(provider: str) -> bool:
    _known(provider)
    settings = load()
    gone = settings.get("api_keys", {}).pop(provider, None)
    save(settings)
    return gone is not None


def masked(key: str) -> str:
    return f"{key[:4]}…{key[-4:]}" if len(key) > 12 else "****"


def list_api_keys() -> dict[str, dict]:
    """Where each provider's key comes from, masked."""
    out = {}
    for provider, variable in PROVIDERS.items():
        env, filed = os.getenv(variable) if variable else None, load().get("api_keys", {}).get(provider)
        key = env or filed
        out[provider] = {"source": "environment" if env else "file" if filed else None, "key": masked(key) if key else None}
    return out


def wizard(ask=input, secret=getpass.getpass) -> int:
    """Ask for a provider and its key until nothing is answered; returns how many keys were set."""
    names, count = list(PROVIDERS), 0
    while True:
        for i, (name, x) in enumerate(list_api_keys().items(), 1):
            print(f"{i}. {name}: {x['key'] or 'not set'}")
        said = ask("Number or name of a provider (empty: done): ").strip().lower()
        if not said:
            return count
        provider = names[int(said) - 1] if said.isdigit() and 0 < int(said) <= len(names) else said
        if provider not in PROVIDERS:
            print(f"Unknown provider: {said}")
        elif not PROVIDERS[provider]:
            print(f"{provider} needs no key")
        elif key := secret(f"Key for {provider} (empty: leave): ").strip():
            set_api_key(provider, key)
            count += 1


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="millrace-keys", description="Keys of text models")
    g = p.add_mutually_exclusive_group()
    g.add_argument("--wizard", action="store_true")
    g.add_argument("--list", action="store_true")
    g.add_argument("--set", metavar="PROVIDER")
    g.add_argument("--remove", metavar="PROVIDER")
    g.add_argument("--check", metavar="PROVIDER")
    g.add_argument("--info", action="store_true")
    given = p.parse_args(args)
    try:
        if given.wizard:
            print(f"{wizard()} keys set")
        elif given.set:
            _known(given.set)
            set_api_key(given.set, getpass.getpass(f"Key for {given.set}: "))
        elif given.remove:
            print("removed" if remove_api_key(given.remove) else "no key found")
        elif given.check:
            _known(given.check)
            found = bool(get_api_key(given.check))
            print("set" if found else "not set")
            return int(not found)
        elif given.info:
            print(store())
        else:
            for provider, x in list_api_keys().items():
                print(f"{provider}: {x['key'] or 'not set'}" + (f" ({x['source']})" if x["source"] else ""))
    except ValueError as error:
        print(error)
        return 1
    return 0
