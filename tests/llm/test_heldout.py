"""Precision and recall on texts that no list and no cue was drawn up from: written after the operator, with other people's names.

At first run: email and address 1.00 of either, id 1.00 and 0.80 (one number that was wrongly not marked here), phone 0.86 and 1.00,
name 0.79 and 0.86. Two faults that the run showed were mended then (a Chinese title taken into a name, "name is" as a cue).
"""

import re
from collections import Counter

from lexframe.llm import pii

TEXTS = """
The plumber came on Tuesday; his name is [[name:Declan Farrow]] and he can be reached on [[phone:+44 20 7946 0018]] until six.
Invoice for Ms [[name:Okonkwo]], [[address:14 Wetherby Road]], Leeds. Questions to [[email:accounts@wetherby-lettings.co.uk]].
I spoke with [[name:Priya Raghunathan]] about the lease, and she told me that the keys are with Mr [[name:Haverstock]].
Dear Dr. [[name:Villanueva]], the results for patient 4711 came back on 12 March. Regards, [[name:Tobias Lindqvist]]
Her social security number [[id:078-05-1120]] was printed on the card, as everyone knows from the story of 1938.
Please transfer the fee to [[id:DE89 3704 0044 0532 0130 00]] by Friday and mail [[email:kasse [at] verein-nord [dot] de]].
Card [[id:4539 1488 0343 6467]] was declined twice, order 20231105 was not.
According to [[name:Marguerite Delacroix-Besson]], the bakery opens at seven; call [[phone:01 42 68 53 00]] to be sure.
Madame [[name:Besson]] habite au [[address:27 rue des Tanneurs]], à Colmar, depuis 1987.
Écrivez à [[email:jean-luc.moreau+devis@atelier-bois.fr]] ou appelez le [[phone:+33 6 12 34 56 78]].
Frau [[name:Edelgard Wuttke]] wohnt in der [[address:Lindenallee 112 b]] in Potsdam und ist unter [[phone:0331/234567-12]] zu erreichen.
Mit freundlichen Grüßen [[name:Jörg Petzold]]
Die Rechnung an Herrn [[name:Petzold]], [[address:Am Mühlbach 4]], kam zurück.
El señor [[name:Iñigo Arrizabalaga]] vive en la [[address:calle Mayor 23, 4º B]] y su correo es [[email:iarriza@correo.example]].
Firmado por [[name:Leocadia Bermúdez]], documento de identidad [[id:12345678-Z]].
Звоните по телефону [[phone:8 (495) 123-45-67]] или пишите на [[email:sklad@ooo-vesna.example]].
Это указала [[name:Аглая Воскресенская]], адрес: [[address:ул. Садовая, д. 17, кв. 45]].
С уважением, [[name:Ростислав Княжнин]]
氏名[[name:長谷川 恵]]、電話[[phone:03-1234-5678]]までご連絡ください。
この件は[[name:長谷川]]さんから聞いた。
[[name:欧阳雪]]女士告诉我，地址是[[address:南京路128号3单元501室]]。
身份证号[[id:11010519491231002X]]，姓名[[name:司马青]]。
The meeting moved from 14:30 to 16:00, room 204, and the price rose from 1 200.00 to 1 350.50.
Rose bushes and ivy cover the wall in May; the paper says so on page 12-340.
Version 10.2.14 of the tool fixes bug 558-2210 of 2021-09-30, see https://tracker.example/issue/123456789.
In the will she left the field and the hill to the village of Ashcombe.
Hope is frank about it, and grace will follow.
Contact: [[name:Siobhán Ní Dhomhnaill]], [[phone:(555) 867-5309]], or the front desk.
It was signed by [[name:J. R. Castellane]] and then by [[name:Castellane, Ines]] on the same day.
We moved from [[address:Flat 3, 88 Harcourt Street]] to [[address:5 Priory Close]] last year.
My neighbour [[name:Gwendolyn Achterberg]] said that the parcel for [[name:Achterberg]] was hers.
"""


def score():
    count = Counter()
    for line in TEXTS.strip().split("\n"):
        text, truth, at = "", set(), 0
        for m in re.finditer(r"\[\[(\w+):(.*?)\]\](?!\])", line):
            text += line[at : m.start()]
            truth.add((len(text), len(text) + len(m[2]), m[1]))
            text += m[2]
            at = m.end()
        text += line[at:]
        found = {(a, b, k) for a, b, k, _ in pii.find_spans(text)}
        for kind in pii.KINDS:
            t, f = ({x for x in s if x[2] == kind} for s in (truth, found))
            count.update({(kind, "true"): len(t), (kind, "found"): len(f), (kind, "both"): len(t & f)})
        if found != truth:
            print(text, "\n   missed", [(text[a:b], k) for a, b, k in truth - found], "\n   wrong", [(text[a:b], k) for a, b, k in found - truth])
    return count


def test_held_out_texts():
    c = score()
    shown = {k: (c[k, "both"] / c[k, "true"], c[k, "both"] / max(1, c[k, "found"])) for k in pii.KINDS}
    print(shown)
    assert all(r >= 0.75 and p >= 0.75 for r, p in shown.values())
