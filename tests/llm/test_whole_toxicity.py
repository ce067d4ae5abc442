"""No text that the toxicity grammar would match is passed over."""

from __future__ import annotations

import pyarrow as pa

from stroma.llm.shared import text_buffers
from stroma.llm.toxicity_fst import INSULTS, Grammar, Lexicon

TOXIC = ["¡Idiota!", "eres un ESTÚPIDO", "“Idiot”", "«idiot»", "you—idiot—you", "idiot…", "idiot you", "¿imbécil?", "IMBÉCIL", "TÖTEN werde ich dich", "‘idiot’", "日本 idiot。", "÷idiot÷", "_idiot_", "ein Trottel„", "Židioten", "stupidÉst", "ÉSCORIA"]


def test_every_text_that_the_grammar_matches_is_read():
    grammar = Grammar(Lexicon(dict.fromkeys(INSULTS, 1.0) | {"éscoria": 1.0}, {"stupidé": 1.0, "židi": 1.0}))
    clean = ["señor, ¿cómo está?", "„schön“", "idiotée", "x" * 50, "", "日本語", "idiotа"]
    found = grammar.suspects(*text_buffers(pa.array(TOXIC + clean)))
    assert [t for t, f in zip(TOXIC, found) if not f] == []
    assert [t for t, f in zip(clean, found[len(TOXIC) :]) if f] == []
