"""Plain versions of what the classifiers compute, one number at a time."""

import math

from factloom.llm import quality, toxicity


def weight_by_hand(symbols):
    """The rules of the grammar, clause by clause, without any machine."""
    aimed = any(s == toxicity.TARGET for s, _ in symbols)
    total, insults = 0.0, 0
    for i, (s, weight) in enumerate(symbols):
        before = [x for x, _ in symbols[:i]]
        if s == toxicity.INSULT:
            factor = (toxicity.AIMED if aimed else 1.0) * (toxicity.FURTHER if insults else 1.0)
            insults += 1
        elif s == toxicity.THREAT:
            factor = 0.0 if not aimed else toxicity.INTENDED if toxicity.INTENT in before else 1.0
        else:
            continue
        # A threat to nobody is read on as any other word.
        if s == toxicity.INSULT or aimed:
            factor *= toxicity.NEGATED if toxicity.NEGATION in before[-toxicity.REACH :] else 1.0
            factor *= toxicity.REPORTED if toxicity.REPORT in before else 1.0
        total += weight * factor
    return total


def toxicity_by_hand(model, lexicon, text):
    """Score of a text: every clause is read, whether it holds a match or not."""
    text = (text or "").lower()
    found, weights, at = lexicon.matches(text), [], 0
    while at <= len(text):
        end = next((i for i in range(at, len(text)) if text[i] in ".!?;:\n"), len(text))
        symbols = [found.get(m.start()) or lexicon.closed.get(m[0], (toxicity.OTHER, 0.0)) for m in toxicity._TOKEN.finditer(text, at, end)]
        weight = weight_by_hand(symbols)
        if weight > 0:
            weights.append(weight)
        at = end + 1
    x = (math.log1p(sum(weights)), math.log1p(max(weights, default=0.0)), math.log1p(len(weights)), 1.0)
    return 1 / (1 + math.exp(-sum(b * v for b, v in zip(model.beta, x))))


def attention_by_hand(model, bag):
    """Score of a document from its passages' features."""
    w, rows, weights = model.w, [], []
    for x in bag.astype(float):
        x = [min(8.0, max(-8.0, (x[i] - model.mean[i]) / model.scale[i])) for i in range(len(x))]
        h = [math.tanh(sum(x[i] * w["W"][i, j] for i in range(len(x))) + w["b"][j]) for j in range(quality.HIDDEN)]
        gate = 0.0
        for k in range(quality.GATE):
            t = math.tanh(sum(h[j] * w["V"][j, k] for j in range(len(h))) + w["v"][k])
            g = 1 / (1 + math.exp(-sum(h[j] * w["U"][j, k] for j in range(len(h))) - w["u"][k]))
            gate += w["a"][k] * t * g
        rows.append(h)
        weights.append(math.exp(gate))
    z = [sum(a * h[j] for a, h in zip(weights, rows)) / sum(weights) for j in range(quality.HIDDEN)]
    return 1 / (1 + math.exp(-sum(z[j] * w["o"][j] for j in range(len(z))) - w["c"][0]))
