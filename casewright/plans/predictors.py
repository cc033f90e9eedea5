"""Two predictors over text cases: by text length, and uniform."""

from __future__ import annotations

import time

from casewright.operators.inference import Abstained, Predictor, Unsupported


class ByLength(Predictor):
    """Says ``1`` for texts over ``cut`` characters; refuses very long ones and empty ones."""

    def __call__(self, state, questions):
        n = len(state["text"])
        if n > self.options.get("longest", 20_000):
            raise Unsupported("text is longer than the maximum model length")
        if n < self.options.get("shortest", 20):
            raise Abstained("too little to go on")
        pick = "1" if n > self.options.get("cut", 800) else "0"
        answers = {}
        for key, q in questions.items():
            spread = {o: (0.8 if o == pick else 0.2 / (len(q["criteria"]) - 1)) for o in q["criteria"]}
            answers[key] = {"type": "choice", "choice": pick, "probabilities": spread}
        return {"answers": answers}, None


class Uniform(Predictor):
    """Equal probabilities; picks the first option."""

    def batch(self, payloads):
        return [(self._answer(p["questions"]), None) for p in payloads]

    @staticmethod
    def _answer(questions):
        answers = {}
        for key, q in questions.items():
            if q["type"] == "noul":
                answers[key] = {"type": "noul", "noul": 0.5}
            else:
                options = list(q["criteria"])
                answers[key] = {
                    "type": "choice", "choice": options[0], "probabilities": dict.fromkeys(options, 1 / len(options))
                }
        return {"answers": answers}


class Unbuildable(ByLength):
    """Cannot be set up, like a predictor whose model is missing."""

    def warmup(self):
        raise RuntimeError("no model")


class Unreachable(ByLength):
    """Fails every call after a moment, like a server that is down."""

    def __call__(self, state, questions):
        time.sleep(0.01)
        raise ConnectionError("no answer")


class WholeCalls(ByLength):
    """Answers whole calls at once; a call with a text over ``longest`` characters fails as one."""

    def batch(self, payloads):
        if any(len(p["state"]["text"]) > self.options.get("longest", 20_000) for p in payloads):
            raise RuntimeError("call failed")
        return [self(**p) if len(p["state"]["text"]) >= 20 else Abstained("too little to go on") for p in payloads]
