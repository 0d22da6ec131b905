"""Rule packs bound to the test tables.

The tables hold invented prose without any production phrase.  These packs
add patterns that do occur in it, so that every branch of the rules is taken
by some rows; the production entries stay in front.
"""
from __future__ import annotations

from riskframe import config as C
from riskframe.config import RulePack

RULES = RulePack(
    jailbreak=[*C.JAILBREAK_PATTERNS, "that (the|that) (was|with)", "que la [a-z]+ux "],
    override=[*C.INSTRUCTION_OVERRIDE_PATTERNS, "with (the|an) (in|to)", "der die"],
    hard_ban=[*C.HARD_BAN_KEYWORDS, "and and", "que que"],
    suspicious=[*C.SUSPICIOUS_PHRASES, "to the", "der und"])
MEDIUM_PHRASES = ["how to", "steps", "of the", "que en"]
