"""The built-in lexicon at its own weights: matched clauses make a text toxic, isolated words don't."""

import pytest

from tessera.llm import toxicity

GRAMMAR = toxicity.Grammar({w: toxicity.W_INSULT for w in toxicity.INSULTS})
LONG = "The council met in spring and wrote down what it had seen. " * 400


@pytest.mark.parametrize("word", toxicity.INSULTS)
def test_insult_needs_a_target(word):
    assert GRAMMAR.score(f"{LONG}Somebody took out the {word} again. {LONG}")[0] < toxicity.THRESHOLD
    assert GRAMMAR.score(f"{LONG}You are {word}. {LONG}")[0] >= toxicity.THRESHOLD


@pytest.mark.parametrize("text", ["I will kill you", "Ich werde dich töten", "Wir werden sehen. Ich werde euch verprügeln!", "Je vais te tuer", "je vais vous détruire", "Voy a matarte", "Te voy a matar", "voy a golpear a ustedes", "i am going to kill you", "Go kill yourself", "I'll be killing you", "you're an idiot"])
def test_threats(text):
    assert GRAMMAR.score(text)[0] >= toxicity.THRESHOLD


@pytest.mark.parametrize("text", ["They kill time", "Tu vas tuer le temps", "Sie töten die Zeit", "Ich werde die Zeit töten", "Voy a matar el tiempo", "I will see you", "werde dich sehen", "te voy a ver", "He isn't stupid.", "They aren't idiots", "You don't look stupid", "I will not kill you", "Don't kill yourself", "Please take out the trash. The clown made the children laugh. What scum.", "You must see it to beat the time"])
def test_no_threats(text):
    assert GRAMMAR.score(text)[0] < toxicity.THRESHOLD
