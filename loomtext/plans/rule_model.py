"""A model of rules for runs without a server: it answers this library's prompts from what they contain."""

from __future__ import annotations

import re


class PatternModel:
    def __call__(self, prompts: list[str]) -> list[str]:
        return [self.answer(p) for p in prompts]

    def answer(self, prompt: str) -> str:
        kind, _, _ = prompt.partition("\n")
        part = lambda name: (re.search(rf"(?ms)^{name}: (.*?)(?=^[A-Z][a-z]+: |\Z)", prompt) or [None, ""])[1].rstrip("\n")
        if kind.startswith("Copy the parts"):
            value, target = part("Value"), prompt.partition("\nTarget: ")[2]
            return value if value and value.lower() in target.lower() else "none"
        if kind.startswith("In one sentence"):
            return f"Replace the {part('Type')} by its kind."
        if kind.startswith("Rewrite the sequence"):
            text = prompt.partition("\nSequence: ")[2]
            for s in part("Spans").split("; "):
                if s:
                    text = re.sub(re.escape(s), "[REMOVED]", text, flags=re.IGNORECASE)
            return text
        return ""
