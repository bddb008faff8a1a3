"""Canned completion functions: what the tests and checks use instead of a model."""

from __future__ import annotations

import json
import re
import time

from patchlens.operators.complete import Messages, Reply

_NUMBER = re.compile(r"File: \S*?m(\d+)")


def reviewed_number(messages: Messages) -> int:
    found = _NUMBER.search(messages[-1]["content"])
    return int(found.group(1)) if found else 0


def review_reply(n: int) -> dict:
    """A review that depends on the file's number only, so that a check can foretell it."""
    issues = [{"type": "QUALITY", "severity": "HIGH", "line": n % 9, "title": f"T{n}"}] if n % 2 else []
    return {"issues": issues, "summary": f"file {n}", "risk_score": str(n % 10), "recommendation": "COMMENT"}


def canned_reviews(batch: list[Messages]) -> list[Reply]:
    """Every seventh file fails, every fifth gets an answer without JSON."""
    replies: list[Reply] = []
    for messages in batch:
        n = reviewed_number(messages)
        if n % 7 == 0:
            replies.append((None, "service unavailable", None))
        elif n % 5 == 0:
            replies.append(("I have nothing to say.", None, None))
        else:
            replies.append(("```json\n" + json.dumps(review_reply(n)) + "\n```", None, None))
    return replies


_asked: set[int] = set()


def slow_reviews(batch: list[Messages]) -> list[Reply]:
    """Every 997th file never gets a reply, every third of the others fails when it is asked about first."""
    replies: list[Reply] = []
    for messages in batch:
        n = reviewed_number(messages)
        if n % 997 == 0:
            time.sleep(5)
        if n % 3 == 0 and n not in _asked:
            _asked.add(n)
            replies.append((None, "service unavailable", None))
        else:
            _asked.discard(n)
            replies.append((json.dumps(review_reply(n)), None, None))
    return replies


def canned_agent(batch: list[Messages]) -> list[Reply]:
    """Step 1 searches or calls a tool, step 2 hands in the review; some rows never finish."""
    replies: list[Reply] = []
    for messages in batch:
        user = messages[-1]["content"]
        n = reviewed_number(messages)
        if not user.startswith("## Review"):
            replies.append(("- nothing found", None, None))
        elif n % 11 == 0:
            replies.append((None, "service unavailable", None))
        elif n % 13 == 0:
            replies.append(("Let me think.", None, None))
        elif "step 1/" in user:
            call = {"tool": "search_framework", "args": {"query": "get item"}} if n % 2 else {"tool": "analyze_security", "args": {"code": "x"}}
            replies.append((json.dumps(call), None, None))
        else:
            replies.append((json.dumps({"tool": "final_review", "args": review_reply(n)}), None, None))
    return replies


def canned_any(batch: list[Messages]) -> list[Reply]:
    """canned_agent for agent prompts and their tools, canned_reviews for all others."""
    return [
        (canned_reviews if m[-1]["content"].startswith("Review this ") else canned_agent)([m])[0] for m in batch
    ]
