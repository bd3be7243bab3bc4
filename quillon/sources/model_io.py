"""Models as JSON files: Name, Parameters, and Distributions with the transform last."""

from __future__ import annotations

import json

from ..spec import KmerSpec, Member, Model


def to_json(model: Model, kind: str | None = None) -> str:
    """The model's file; kind is the name that other readers of such files ask for."""
    features = model.features()
    kind = kind or ("kmers" if model.spec else "scores")
    base = sorted(model.names)
    number = {i: k for k, i in enumerate(base)}
    parameters: dict = {"Cooccurrence": model.cooccurrence, "Features": [[number[a], number[b]] for a, b in features]}
    if s := model.spec:
        parameters |= {
            "M": s.shortest, "N": s.longest, "Binarize": s.binarize, "Complement": s.complement, "Reverse": s.reverse,
            "Revcomp": s.revcomp, "Alphabet": s.alphabet, "Kmers": [model.names[i] for i in base],
            "MaxAmbiguous": [s.ambiguous_at(k) for k in range(s.shortest, s.longest + 1)],
        }
    else:
        parameters |= {"Index": base, "Names": [model.names[i] for i in base]}
    offsets = [0.0] + [model.transform.get(f, (0.0, 1.0))[0] for f in features]
    scales = [1.0] + [model.transform.get(f, (0.0, 1.0))[1] for f in features]
    transform = {"Offset": offsets if any(offsets) else [], "Scale": scales if model.transform else []}
    members = [{"Name": "logistic", "Parameters": [m.bias] + [m.theta.get(f, 0.0) for f in features]} for m in model.members]
    name = f"{kind} [{model.summary}]" if model.summary else kind
    return json.dumps({"Name": name, "Parameters": parameters, "Distributions": [*members, {"Name": "transform", "Parameters": transform}]}, indent=1)


def from_json(text: str) -> Model:
    """A model of either kind, told by what its parameters hold, whatever it is called."""
    said = json.loads(text)
    name, p = said["Name"], said["Parameters"]
    summary = name.partition(" ")[2]
    *members, transform = said["Distributions"]
    if "Kmers" in p:
        names = dict(enumerate(p["Kmers"]))
        most = p.get("MaxAmbiguous") or None
        spec = KmerSpec(
            p["M"], p["N"], p["Revcomp"], p["Reverse"], p["Complement"], p["Alphabet"], tuple(most) if most else None, p["Binarize"], p.get("Cooccurrence", False)
        )
        base = list(names)
    elif "Index" in p:
        base, spec = list(p["Index"]), None
        names = dict(zip(base, p.get("Names") or [str(i + 1) for i in base], strict=True))
    else:
        raise ValueError(f"not a model: {name}")
    features = [(base[a], base[b]) for a, b in p["Features"]]
    out = []
    for m in members:
        theta = m["Parameters"]
        if len(theta) != len(features) + 1:
            raise ValueError("coefficients and features don't match in number")
        out.append(Member(theta[0], dict(zip(features, theta[1:], strict=True))))
    offsets, scales = transform["Parameters"]["Offset"], transform["Parameters"]["Scale"]
    fitted = {f: (offsets[i + 1] if offsets else 0.0, scales[i + 1]) for i, f in enumerate(features)} if scales else {}
    return Model(out, names, spec, fitted, summary.strip("[]"), p.get("Cooccurrence", False))


def save(model: Model, path: str, spark, kind: str | None = None) -> None:
    """Write the model through Spark's file system as one line-free text part."""
    spark.createDataFrame([(json.dumps(json.loads(to_json(model, kind))),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(path: str, spark) -> Model:
    return from_json(spark.read.option("wholetext", True).text(path).first()["value"])
