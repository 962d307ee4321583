"""Licence scans: a paragraph classifier on word 1- and 2-grams, calibrated, and confirmed against templates.

A multinomial logistic regression, fitted from the tables below, names a paragraph's licence family or calls
it unknown. Its training paragraphs are names of licences in frames of six languages, paragraphs of licences, names of
licences of no family, and ordinary ones. Some frames, names of no family and ordinary paragraphs are kept apart from the
fit: a temperature and the threshold of the unknown class are set on one part of them.

A named family stands only if a template confirms it; otherwise the paragraph is unknown. The paragraph needs most of the
template's word pairs, and one that only this family's templates have. What follows a negation doesn't count, nor does
"license" in a compound ("license plate"). A name, other than a paragraph of a licence, also needs a word that grants or
labels (GRANTS), or at most BARE other words around it: else it is only mentioned.

Features have a word that ordinary paragraphs don't have, so a paragraph without such a word is unknown at once.
Scoring uses built-in expressions only, in place, without a shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .logistic import fit_logistic

WORD = r"[\p{L}\p{N}]+(?:[.+-][\p{L}\p{N}]+)*\+?"
#: A paragraph ends at a blank line, or at a line's end after one of these marks; other lines are wrapped ones.
BREAK = r"(?<=[.!?:;])[ \t\r]*\n|\n(?:[ \t\r]*\n)+"
UNKNOWN = "unknown"
#: Share of a template's word pairs that a paragraph needs to confirm its family.
CONFIRM = 0.7
#: The threshold is the least one at which this share of the calibration paragraphs that are named is named rightly.
PRECISION = 0.99
#: Of five parts of the frames, of the names of no family and of the ordinary paragraphs, this one calibrates, and the next
#: is only for figures.
CALIBRATE, HELD_OUT = 3, 4
#: Words beside a bare name at most.
BARE = 3

#: Names of licences.
NAMES = {
    "agpl": ("GNU Affero General Public License", "GNU Affero General Public License, version 3", "GNU AGPL", "AGPLv3", "AGPL-3.0-or-later"),
    "apache": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache Software License", "Apache-2.0", "Apache 2.0"),
    "bsd": ("BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "3-Clause BSD License", "Simplified BSD License", "BSD-3-Clause", "BSD-2-Clause", "BSD-style license"),
    "cc-by": ("CC BY 4.0", "CC-BY-4.0", "CC BY 3.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License"),
    "cc-by-nc": ("CC BY-NC 4.0", "CC-BY-NC-4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0"),
    "cc-by-nd": ("CC BY-ND 4.0", "CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "cc-by-sa": ("CC BY-SA 4.0", "CC-BY-SA-4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License"),
    "cc0": ("CC0 1.0 Universal", "CC0 1.0", "CC0", "CC0-1.0", "Creative Commons Zero", "Unlicense"),
    "gpl": ("GNU General Public License", "GNU General Public License, version 3", "GNU General Public License, version 2", "GNU GPL", "GNU GPL v3", "GPL v2", "GPLv3", "GPLv2", "GPL-3.0-or-later", "GPL-2.0-only"),
    "lgpl": ("GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "GNU Library General Public License", "GNU Library General Public License, version 2", "GNU LGPL", "LGPLv3", "LGPL v3", "LGPL 2.1", "LGPL-2.1-only"),
    "mit": ("MIT License", "MIT Licence", "MIT-Lizenz", "licence MIT", "licencia MIT", "licenza MIT", "licença MIT", "SPDX-License-Identifier: MIT", "Expat License"),
    "mpl": ("Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License", "MPL 2.0", "MPL-2.0"),
}

#: Names of licences of no family above, and versions that may follow them.
OTHERS = (
    "Eclipse Public License", "Common Public License", "Netscape Public License", "IBM Public License", "European Union Public Licence", "Common Development and Distribution License", "Q Public License", "Sun Public License", "ISC License", "Boost Software License", "zlib License",
    "Artistic License", "Academic Free License", "Open Software License", "SIL Open Font License", "Python Software Foundation License", "PHP License", "Zope Public License", "Microsoft Public License", "PostgreSQL License", "Server Side Public License", "GNU Free Documentation License",
    "Open Database License", "LaTeX Project Public License", "NCSA License", "X11 License", "EPL", "EUPL", "CDDL", "CPL",
)
VERSIONS = ("", " v 1.0", " v 2.0", " version 1.0", " version 2", " version 2.0", " version 3", " 1.0", " 2.0", " 3.0")

#: Negations, words that may stand between a negation and a name, and words that make compounds with "license".
NEGATIONS = ("not", "no", "never", "without", "neither", "nor", "isn", "aren", "wasn", "nicht", "kein", "keine", "keiner", "ohne", "pas", "sans", "sin", "non", "senza", "não", "sem")
BETWEEN = (
    "a", "an", "any", "the", "t", "is", "are", "be", "been", "longer", "yet", "covered", "governed", "licensed", "released", "distributed", "published", "available", "under", "by", "with", "terms", "of", "or", "in", "either", "unter", "der", "die", "dem", "den", "einer", "lizenziert", "steht", "veröffentlicht",
    "sous", "la", "le", "les", "de", "du", "une", "un", "licence", "distribué", "publié", "bajo", "está", "una", "el", "publicado", "sotto", "è", "rilasciato", "sob", "uma", "o", "licenciado", "lizenz", "licencia", "licenza", "licença",
)
COMPOUNDS = ("plate", "plates", "number", "numbers", "holder", "holders", "fee", "fees", "debate", "debates", "wars", "family", "families", "text", "texts")

#: Words that grant, or label a name as the licence of something.
GRANTS = (
    "licensed", "released", "distributed", "distribute", "published", "available", "under", "terms", "subject", "governed", "covered", "dedicated", "waived", "uses", "spdx-license-identifier", "license", "licence", "lizenz", "lizenziert", "unter", "steht", "veröffentlicht", "freigegeben", "verwendet",
    "sous", "distribué", "publié", "utilise", "bajo", "licencia", "distribuye", "publica", "publicado", "usa", "sotto", "licenza", "rilasciato", "distribuito", "sob", "licença", "licenciado", "distribuído",
)

#: Paragraphs of licences and of their notices.
TEXTS = {
    "agpl": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",),
    "apache": ("Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "you may not use this file except in compliance with the License", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"),
    "cc-by-sa": ("Text is available under the Creative Commons Attribution-ShareAlike License",),
    "cc0": ("This is free and unencumbered software released into the public domain", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "Dedicated to the public domain under CC0 1.0"),
    "gpl": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE", "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/"),
    "lgpl": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",),
    "mit": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    "proprietary": ("All rights reserved", "Alle Rechte vorbehalten", "Tous droits réservés", "Todos los derechos reservados", "Tutti i diritti riservati", "Todos os direitos reservados", "No part of this publication may be reproduced, stored or transmitted without the prior written permission of the publisher", "Proprietary and confidential", "Unauthorized copying of this file, via any medium, is strictly prohibited", "redistribution is strictly prohibited without written permission"),
}

#: Frames around names of licences.
FRAMES = (
    "{}", "Licensed under the {}", "Released under the {}.", "Distributed under the terms of the {}", "This project is licensed under the {} - see the file for details", "This work is licensed under {}", "Available under {}, with exceptions",
    "SPDX-License-Identifier: {}", "Lizenziert unter der {}", "Dieses Werk steht unter der {}", "Veröffentlicht unter {}", "Sous {}", "Ce projet est distribué sous {}", "Publicado bajo {}", "Este proyecto se distribuye bajo la {}",
    "Rilasciato sotto {}", "Questo progetto è distribuito con {}", "Licenciado sob a {}", "Este trabalho está sob {}",
)

#: Ordinary paragraphs; their words alone are no features.
ORDINARY = (
    "The work of this year was done under the old terms, and a copy of the report is at the library for all who will use it", "It is free for all, and you can have it as you like, or not, in part or in whole, if it is not of any use to you", "This was on the radio in January, with or without music", "In 2004 version 3 of the plan was done, and 2.0 was 4.0 times as large as 1.0, so 2.1 or 3.0 may be next",
    "The source of the river is in the north, and its form is that of a file of hills", "The general said that the public had a right to know", "No part of the garden is in the shade, and any person can sit at the pond and see this project or that one", "The project has a list of names and details, and each is about its own code, program, document or text",
    "Die Arbeit steht unter dem Baum und ist in der freien Zeit fertig, mit der Familie und mit dem Hund", "Wir fahren mit einem Auto und mit den Kindern, aber ohne das Werk und ohne die anderen", "Das Haus mit dem roten Dach ist für alle da, und sie kommt mit ihm und mit uns",
    "Le travail est sous la table, et ce projet de la ville est pour tous avec les autres", "La maison est à nous, et elle vient avec lui sans le chien dans une rue", "Este trabajo está bajo la mesa, y el proyecto de la casa se hace con los otros", "La ciudad es de todos, y ella viene con él sin el perro por una calle",
    "Il lavoro è sotto la tavola, e questo progetto della casa si fa con gli altri", "O trabalho está sob a mesa, e este projeto da casa se faz com os outros, não com a gente",
)

#: Ordinary paragraphs with words of licences.
NEAR_MISSES = (
    "A driver needs a licence to drive, and a license costs money in the city", "The Apache helicopter flew over the valley", "The Apache HTTP server is popular", "He studied at MIT, and so did I", "MIT is a university", "Attribution of the painting to the master is in doubt", "Permission to land was granted to the crew, and the files were associated with the case",
    "The software runs on a computer and its documentation is a binary file", "Common people and creative minds met at an international fair", "Released in the spring, the film was a success with the public", "An identifier is a name", "He was distributed the bread by style and later reserved a seat", "All prior records are in written form, and rights of way are strictly local",
    "Copying by hand is slow, and a form has to be signed by the holder of the card", "The domain of the king was open to the public", "Der Führerschein ist eine Lizenz zum Fahren", "Nur mit Lizenz darf man hier fischen", "La licencia de conducir es de este año", "Il a une licence en droit et une licence de chasse", "La licenza di caccia costa molto", "A licença de motorista é cara",
    "The terms of trade are under review, without warranty of success", "You may modify the recipe and distribute the cake", "A copy of the map was sold without charge", "The publisher reserves the right to change the date", "The conditions were met, and the notice hung above the door", "The clause in the contract was void", "Mozilla is a company in California", "The GNU is an animal of Africa", "The public was not granted permission to copy the list",
    "The film was made available to the public under the title of the book", "Alle Kinder haben Rechte und Pflichten", "Tous les enfants ont des droits", "Todos los niños tienen derechos", "Tutti hanno diritti e doveri", "Todos têm direitos e deveres", "Copyright law is taught in the third year", "The copyright holder was not at the meeting", "The library is free and open to the public", "A general public license plate", "Zero is a number in common use",
    "The state reserved all seats for those with rights", "The prior owner gave written permission to enter", "The company keeps the recipe confidential", "The contributors to the fund are listed below", "Simplified rules of chess", "The version of the play was a success in compliance with the wishes of the author", "To deal in stock is to buy and sell", "He drove under the influence and lost his license", "Universal suffrage was granted in that year", "The foundation is free of charge on Sundays",
)


def words(paragraph: str) -> list[str]:
    return regex.findall(WORD, paragraph.lower())


def n_grams(parts: list[str]) -> list[str]:
    return [*parts, *(f"{a} {b}" for a, b in zip(parts, parts[1:], strict=False))]


def paragraphs(text: str | None) -> list[str]:
    return regex.split(BREAK, text) if text is not None else []


def framed() -> list[tuple[str, str, int]]:
    """(family, paragraph, part): each name in each frame, by the frame's part; each paragraph of a licence; each name of no
    family with a version in a frame, by the name's part if the frame's is 0; and the ordinary paragraphs."""
    rows = [(family, frame.format(name), j % 5) for family, names in NAMES.items() for name in names for j, frame in enumerate(FRAMES)]
    rows += [(family, text, 0) for family, texts in TEXTS.items() for text in texts]
    rows += [(UNKNOWN, FRAMES[(3 * i + j) % len(FRAMES)].format(other + v), i % 5) for i, other in enumerate(OTHERS) for j, v in enumerate(VERSIONS)]
    rows += [(UNKNOWN, p, k % 5) for k, p in enumerate((*ORDINARY, *NEAR_MISSES))]
    return rows


def _pairs_of(paragraph: str) -> tuple[str, ...]:
    """A paragraph's word pairs, or its one word."""
    w = words(paragraph)
    return tuple(dict.fromkeys(n_grams(w)[len(w) :] if len(w) > 1 else w))


@dataclass(frozen=True)
class Template:
    grams: tuple[str, ...]
    own: tuple[str, ...]  # those of them that only this family has; without figures, if there are such
    words: tuple[str, ...] | None  # of a name; None for a paragraph of a licence


@lru_cache
def templates() -> dict[str, tuple[Template, ...]]:
    """The names and paragraphs of each family."""
    found = {f: [(p, _pairs_of(p), p in NAMES.get(f, ())) for p in (*NAMES.get(f, ()), *TEXTS.get(f, ()))] for f in sorted({*NAMES, *TEXTS})}
    foreign = {g for p in (*ORDINARY, *NEAR_MISSES, *(o + v for o in OTHERS for v in VERSIONS)) for g in n_grams(words(p))}

    def template(family: str, paragraph: str, grams: tuple[str, ...], name: bool) -> Template:
        taken = foreign.union(*(g for f, of in found.items() if f != family for _, g, _ in of))
        own = [g for g in grams if g not in taken]
        named = [g for g in own if not any(c.isdigit() for c in g)]
        return Template(grams, tuple(named or own), tuple(dict.fromkeys(words(paragraph))) if name else None)

    return {f: tuple(template(f, *t) for t in of) for f, of in found.items()}


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]  # the last is UNKNOWN
    weights: dict[str, tuple[float, ...]]  # of each n-gram, divided by the temperature
    bias: tuple[float, ...]
    cues: tuple[str, ...]  # each feature has one of these words
    temperature: float
    least: float  # a paragraph is unknown below this chance


def _scores(grams: list[str], weights: dict[str, np.ndarray], bias: np.ndarray) -> np.ndarray:
    known = [weights[g] for g in grams if g in weights]
    return bias + (np.sum(known, 0) / np.sqrt(len(known)) if known else 0)


def _chances(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


@lru_cache
def model() -> Model:
    """Fitted on all parts but CALIBRATE and HELD_OUT; temperature and threshold are set on CALIBRATE."""
    rows, families = framed(), (*templates(), UNKNOWN)
    plain = {w for p in ORDINARY for w in words(p)}
    own = [(families.index(f), n_grams(words(p)), part) for f, p, part in rows]
    train = [(k, gs) for k, gs, part in own if part not in (CALIBRATE, HELD_OUT)]
    grams = sorted({g for k, gs in train if k < len(families) - 1 for g in gs if not set(g.split(" ")) <= plain})
    number = {g: k for k, g in enumerate(grams)}
    names = {t.grams[0] for of in templates().values() for t in of if len(t.grams) == 1}
    train += [(len(families) - 1, [g]) for g in grams if " " not in g and g not in names]  # a lone word says little
    w, b = fit_logistic([[number[g] for g in gs if g in number] for _, gs in train], np.array([k for k, _ in train]), len(grams), len(families), l2=1e-5)
    weights = {g: w[k] for g, k in number.items()}
    apart = [(k, gs) for k, gs, part in own if part == CALIBRATE and any(g in weights for g in gs)]
    truth, scores = np.array([k for k, _ in apart]), np.array([_scores(gs, weights, b) for _, gs in apart])
    loss = lambda t: -np.log(np.maximum(_chances(scores / t)[np.arange(len(truth)), truth], 1e-12)).mean()
    t = min(np.geomspace(0.05, 20, 120), key=loss)
    chances = _chances(scores / t)
    best, top = chances.argmax(1), chances.max(1)
    fits = lambda c: (named := (best < len(families) - 1) & (top >= c)).any() and (best == truth)[named].mean() >= PRECISION
    least = next((c for c in np.arange(0.3, 1, 0.01).round(2).tolist() if fits(c)), 0.99)
    cues = tuple(sorted({x for g in grams for x in g.split(" ")} - plain))
    return Model(families, {g: tuple(np.round(w[k] / t, 5).tolist()) for g, k in number.items()}, tuple(np.round(b / t, 5).tolist()), cues, float(t), least)


@lru_cache
def _void() -> tuple[str, str]:
    """Patterns over words joined by spaces: a negation with what it denies, and compounds of "license"."""
    named = {w for of in templates().values() for t in of for w in t.words or ()}
    either = lambda some: "|".join(regex.escape(w) for w in sorted(some))
    return rf"(?<![^ ])(?:{either(NEGATIONS)})(?: (?:{either({*BETWEEN, *named})})(?![^ ]))++", rf"(?<![^ ])licen[cs]e (?:{either(COMPOUNDS)})(?![^ ])"


def confirmed(family: str, parts: list[str]) -> bool:
    text = " ".join(parts)
    for pattern in _void():
        text = regex.sub(pattern, "~", text)
    parts = text.split(" ")
    grams, rest = set(n_grams(parts)), set(parts)
    framed_ = lambda t: t.words is None or bool((rest - set(t.words)) & set(GRANTS)) or len(rest - set(t.words)) <= BARE
    return any(len(grams & set(t.grams)) >= CONFIRM * len(t.grams) and grams & set(t.own) and framed_(t) for t in templates().get(family, ()))


def classify(paragraph: str) -> tuple[str, float, bool]:
    """(likeliest family, its chance, whether it stands) of one paragraph, in plain Python; the plan below must agree."""
    m, parts = model(), words(paragraph)
    grams = n_grams(parts)
    if not any(g in m.weights for g in grams):
        return UNKNOWN, 1.0, False
    chances = _chances(_scores(grams, {g: np.array(m.weights[g]) for g in grams if g in m.weights}, np.array(m.bias)))
    k = int(chances.argmax())
    family = m.families[k]
    return family, float(chances[k]), family != UNKNOWN and bool(chances[k] >= m.least) and confirmed(family, parts)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _pairs(parts: Column) -> Column:
    """The word 2-grams of the words of a paragraph."""
    return F.when(F.size(parts) > 1, F.zip_with(F.slice(parts, 1, F.size(parts) - 1), F.slice(parts, 2, F.size(parts)), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))


def _judged(parts: Column, m: Model) -> Column:
    """struct(family, chance, stands) for the words of a paragraph."""
    table = F.from_json(F.lit(json.dumps(m.weights)), "map<string,array<double>>")  # a constant when the plan is made
    zero = F.array(*[F.lit(0.0)] * len(m.bias))

    def scores(known: Column) -> Column:
        total = F.aggregate(known, zero, lambda a, g: F.zip_with(a, F.element_at(table, g), lambda x, y: x + y))
        root = F.sqrt(F.greatest(F.size(known), F.lit(1)).cast("double"))
        return F.zip_with(total, F.array(*map(F.lit, m.bias)), lambda x, b: b + x / root)

    def named(score: Column) -> Column:
        top = F.array_max(score)
        chance = F.lit(1.0) / F.aggregate(score, F.lit(0.0), lambda a, x: a + F.exp(x - top))
        return F.struct(F.element_at(F.array(*map(F.lit, m.families)), F.array_position(score, top).cast("int")).alias("family"), chance.alias("chance"))

    def of(grams: Column) -> Column:
        stands = lambda j: (j["family"] != UNKNOWN) & (j["chance"] >= m.least) & _confirmed(j["family"], parts)
        judged = lambda known: _let(_let(scores(known), named), lambda j: F.struct(j["family"].alias("family"), j["chance"].alias("chance"), stands(j).alias("stands")))
        return _let(F.filter(grams, lambda g: g.isin(*m.weights)), lambda known: F.when(F.size(known) > 0, judged(known)))

    return _let(F.concat(parts, _pairs(parts)), of)


def _confirmed(family: Column, parts: Column) -> Column:
    texts = lambda some: F.array(*map(F.lit, some))

    def of(rest: Column, grams: Column) -> Column:
        out = F.lit(False)
        for name, own in templates().items():
            some = F.lit(False)
            for t in own:
                fits = (F.size(F.array_intersect(texts(t.grams), grams)) >= CONFIRM * len(t.grams)) & F.arrays_overlap(texts(t.own), grams)
                if t.words is not None:
                    around = F.array_except(rest, texts(t.words))
                    fits = fits & (F.arrays_overlap(around, texts(GRANTS)) | (F.size(around) <= BARE))
                some = some | fits
            out = out | ((family == name) & some)
        return out

    text = F.concat_ws(" ", parts)
    for pattern in _void():
        text = F.regexp_replace(text, pattern, "~")
    return _let(F.split(text, " "), lambda rest: _let(F.concat(rest, _pairs(rest)), lambda grams: of(rest, grams)))


def scan(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: the id, n_paragraphs, notices: an array of (paragraph, family, chance), and n_unknown.

    A paragraph ends at a blank line, or at a line's end after ``. ! ? : ;``; other lines are wrapped ones. Notices
    are paragraphs, numbered from 0, whose family is likely enough and confirmed by a template; n_unknown counts those
    that have words of licences and are no notices. A null text has no paragraphs; an empty one has one. Repeated rows
    and ids give a row each; an empty table gives none; other columns of ``docs`` are not read. No shuffle, no Python.
    """
    m = model()
    split = F.transform(F.split(F.col("text"), BREAK), lambda t, k: F.struct(k.alias("paragraph"), F.regexp_extract_all(F.lower(t), F.lit(WORD), 0).alias("words")))
    own = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    cut = own.select("id", split.alias("p")).select("id", F.size("p").alias("n_paragraphs"), F.filter("p", lambda p: F.exists(p["words"], lambda w: w.isin(*m.cues))).alias("cued"))
    judged = F.transform(F.col("cued"), lambda p: F.struct(p["paragraph"].alias("paragraph"), _judged(p["words"], m).alias("j")))
    out = cut.select("id", F.greatest("n_paragraphs", F.lit(0)).cast("bigint").alias("n_paragraphs"), F.filter(judged, lambda p: p["j"].isNotNull()).alias("judged"))
    notice = lambda p: F.struct(p["paragraph"].alias("paragraph"), p["j"]["family"].alias("family"), p["j"]["chance"].alias("chance"))
    # the judged paragraphs come out of a generator, so that both lists are made of what has been computed once
    bound = out.select("id", "n_paragraphs", F.explode(F.array("judged")).alias("judged"))
    notices = F.transform(F.filter("judged", lambda p: p["j"]["stands"]), notice)
    none = F.array().cast("array<struct<paragraph:int,family:string,chance:double>>")
    n_unknown = F.coalesce(F.size(F.filter("judged", lambda p: ~p["j"]["stands"])).cast("bigint"), F.lit(0).cast("bigint"))
    return bound.select(F.col("id").alias(id_column), "n_paragraphs", F.coalesce(notices, none).alias("notices"), F.greatest(n_unknown, F.lit(0).cast("bigint")).alias("n_unknown"))
