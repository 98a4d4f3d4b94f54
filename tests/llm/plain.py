"""Plain helpers of the tests."""

import re


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
