"""Advice on a frame from any text model: a profile becomes a prompt, the answer becomes a value.

A model is a function from prompt to answer. Without one, settings are read from
arguments, the environment and the key store, and a plain HTTP client is used.
A failing call becomes an answer that says so. Only aggregates and a handful of
example values ever enter a prompt.
"""

from __future__ import annotations

import json
import os
import re
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.keys import PROVIDERS, get_api_key
from millrace.operators.detect import detect_missing
from millrace.operators.eda import top_values
from millrace.plans.stats import fuse, moments, null_count
from millrace.schema import numeric_columns, q, require

# Default models and end points of the providers.
MODELS = {"openai": "gpt-4", "anthropic": "claude-3-sonnet-20240229", "google": "gemini-pro", "ollama": "llama2"}
ENDPOINTS = {"openai": "https://api.openai.com/v1", "anthropic": "https://api.anthropic.com", "google": "https://generativelanguage.googleapis.com", "ollama": "http://localhost:11434"}


def column_profile(df: DataFrame, column: str) -> dict:
    require(df, column)
    base = fuse(df, {"rows": F.count(F.lit(1)), "missing": null_count(df, column), "unique": F.countDistinct(q(column))})
    found = {"name": column, "dtype": dict(df.dtypes)[column]} | base
    if column in numeric_columns(df):
        found |= fuse(df, moments(df, column))
    else:
        found["top_values"] = {r["value"]: r["n"] for r in top_values(df, [column], 5).orderBy("rank").collect()}
    found["examples"] = [r[0] for r in df.where(q(column).isNotNull()).select(q(column).cast("string")).limit(5).collect()]
    return found


def frame_profile(df: DataFrame, target: str | None = None) -> dict:
    found = {"columns": dict(df.dtypes), "rows": fuse(df, {"n": F.count(F.lit(1))})["n"], "missing": detect_missing(df), "numeric": numeric_columns(df)}
    if target and target in df.columns:
        found["target"] = {r["value"]: r["n"] for r in top_values(df, [target], 5).orderBy("rank").collect()}
    return found


def from_json(answer: str) -> object | None:
    """The JSON of an answer, fenced or bare; None if there is none."""
    m = re.search(r"```(?:json)?\s*(.*?)```", answer, re.S)
    try:
        return json.loads((m[1] if m else answer).strip())
    except ValueError:
        return None


class Advisor:
    def __init__(self, model: Callable[[str], str] | None = None, provider: str = "openai", api_key: str | None = None, model_name: str | None = None, base_url: str | None = None, temperature: float | None = None, max_tokens: int | None = None) -> None:
        if provider not in PROVIDERS:
            raise ValueError(f"Unknown provider: {provider}")
        env = provider.upper()
        self.provider, self.call = provider, model
        self.api_key = api_key or get_api_key(provider)
        self.model_name = model_name or os.getenv(f"{env}_MODEL") or os.getenv(f"{env}_DEFAULT_MODEL") or MODELS[provider]
        self.base_url = base_url or os.getenv(f"{env}_BASE_URL") or ENDPOINTS[provider]
        self.temperature = temperature if temperature is not None else float(os.getenv(f"{env}_TEMPERATURE", "0.7"))
        self.max_tokens = max_tokens if max_tokens is not None else int(os.getenv(f"{env}_MAX_TOKENS", "500"))

    def _send(self, prompt: str) -> str:
        body: dict = {"model": self.model_name, "messages": [{"role": "user", "content": prompt}], "temperature": self.temperature, "max_tokens": self.max_tokens}
        head = {"content-type": "application/json"}
        if self.provider == "anthropic":
            url = f"{self.base_url}/v1/messages"
            head |= {"x-api-key": self.api_key or "", "anthropic-version": "2023-06-01"}
        elif self.provider == "google":
            url = f"{self.base_url}/v1beta/models/{self.model_name}:generateContent?key={self.api_key}"
            body = {"contents": [{"parts": [{"text": prompt}]}], "generationConfig": {"temperature": self.temperature, "maxOutputTokens": self.max_tokens}}
        elif self.provider == "ollama":
            url = f"{self.base_url}/api/chat"
            body = {"model": self.model_name, "messages": body["messages"], "stream": False}
        else:
            url = f"{self.base_url}/chat/completions"
            head["authorization"] = f"Bearer {self.api_key}"
        with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), head), timeout=60) as answer:
            got = json.load(answer)
        if self.provider == "anthropic":
            return got["content"][0]["text"]
        if self.provider == "google":
            return got["candidates"][0]["content"]["parts"][0]["text"]
        return got["message"]["content"] if self.provider == "ollama" else got["choices"][0]["message"]["content"]

    def ask(self, task: str, facts: object) -> str:
        prompt = f"{task}\n\nFacts:\n{json.dumps(facts, default=str, indent=1)}"
        try:
            return (self.call or self._send)(prompt)
        except Exception as error:  # an answer is always text
            return f"Error: {error}"

    def suggest_fix(self, df: DataFrame, column: str | None = None, issue_type: str = "missing") -> str:
        facts = column_profile(df, column) if column else frame_profile(df)
        return self.ask(f"Suggest how to fix this data problem: {issue_type}. Name the method and why it fits.", facts)

    def analyze_dataframe(self, df: DataFrame, task: str = "classification", target: str | None = None) -> dict:
        answer = self.ask(f"Assess this table for {task}. Answer as a JSON object with quality issues, steps and risks.", frame_profile(df, target))
        found = from_json(answer)
        return found if isinstance(found, dict) else {"raw_response": answer}

    def explain_cleaning_step(self, action: str, details: dict, context: str | None = None) -> str:
        return self.ask("Explain this data cleaning step in three plain sentences.", {"action": action, "details": details, "context": context})

    def suggest_features(self, df: DataFrame, task: str = "classification", target: str | None = None) -> list:
        answer = self.ask(f"Suggest features to engineer for {task}. Answer as a JSON array of short texts.", frame_profile(df, target))
        found = from_json(answer)
        return found if isinstance(found, list) else [answer]

    def suggest_column_rename(self, df: DataFrame, column: str) -> str:
        if column not in df.columns:
            return f"Error: column '{column}' not found"
        answer = self.ask("Suggest a clear snake_case name for this column. Answer with the name alone.", column_profile(df, column)).strip()
        return answer.splitlines()[0].strip().strip("\"'`") if answer else column

    def suggest_all_column_renames(self, df: DataFrame) -> dict[str, str]:
        found = {c: self.suggest_column_rename(df, c) for c in df.columns}
        return {c: n for c, n in found.items() if n and n != c and not n.startswith("Error")}

    def explain_data_quality_issues(self, df: DataFrame) -> str:
        return self.ask("Summarise the quality problems of this table for its owner.", frame_profile(df))

    def generate_data_documentation(self, df: DataFrame) -> str:
        return self.ask("Write Markdown documentation of this table: purpose, columns, quality.", frame_profile(df))

    def suggest_preprocessing_pipeline(self, df: DataFrame, task: str = "classification") -> str:
        return self.ask(f"List the preprocessing steps for {task} on this table, in order.", frame_profile(df))


def suggest_fix(df: DataFrame, column: str | None = None, issue_type: str = "missing", **options: object) -> str:
    return Advisor(**options).suggest_fix(df, column, issue_type)


def explain_cleaning_step(action: str, details: dict, **options: object) -> str:
    return Advisor(**options).explain_cleaning_step(action, details)


def suggest_column_rename(df: DataFrame, column: str, **options: object) -> str:
    return Advisor(**options).suggest_column_rename(df, column)


def generate_data_documentation(df: DataFrame, **options: object) -> str:
    return Advisor(**options).generate_data_documentation(df)
