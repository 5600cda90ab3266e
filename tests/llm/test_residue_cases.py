"""Single texts: what is residue, what only speaks of it, and that long texts take linear time."""

import time

import pytest

from shelfspark.llm import residue

WORDS = residue._with_words(frozenset())
RESIDUE = [
    "ERROR 503 Service Unavailable, see the error page", "Veuillez activer JavaScript", "Per favore attiva JavaScript per continuare.", "È necessario abilitare JavaScript per visualizzare la pagina.", "asdfgh qwerty",
    "Thank you for your complaint, {{first_name}}", "This textbook by ${author} covers [[topic]]", "{{" + "a" * 500 + "}}", "404 Not Found", "The rivers of the north and their ban The login has expired.", "KeyError: 'title'",
    "many kinds of words in a long text. " * 6000 + "Error 404. More of the text.", "Pagina non trovata: la scheda richiesta manca.", "one fine day one fine day one fine day one fine day",
]
CLEAN = [
    "Chapter [INTRODUCTION] of the book", "Vote on <NATO> matters", "It advises to keep pages readable when scripts are disabled.", "The error page said '404 Not Found' for years.", "Der Wert der Karte ist hoch.", "The form shows the word {{title}} on each page.",
    "The form shows \"" + " ".join(f"w{k}" for k in range(80)) + " {{title}}\" on each page.", "A tag such as <TITLE> means the heading.", "@book{a1, title = {{A {Nested} title}}, note = {{x}}}", "Interviewees recalled that JavaScript was required by one site in ten that they met in those years.", None, "", "  ",
]


@pytest.mark.parametrize("text", RESIDUE)
def test_residue(text):
    assert residue.judge(text, WORDS)[0]


@pytest.mark.parametrize("text", CLEAN)
def test_clean(text):
    assert not residue.judge(text, WORDS)[0]


def test_share_and_kinds():
    bad, share, kinds = residue.judge("Error 404.\n" + "x y z w v u t. " * 10, WORDS)
    assert bad and kinds == "error" and share < 0.1
    assert not residue.judge("Error 404.\n" + "x y z w v u t. " * 10, WORDS, document_share=0.5)[0]
    assert residue.judge("Error 404.", WORDS, document_share=0.5)[0]


@pytest.mark.parametrize("unit", ["the error text here ", "error: {x} \"a' ", "lorem ", "{{a} [[b] <<c> ", "qwert asdf ", "a b c ", "$x @y{ "])
def test_linear(unit):
    began = time.perf_counter()
    residue.judge(unit * (1_000_000 // len(unit)), WORDS)
    assert time.perf_counter() - began < 20
