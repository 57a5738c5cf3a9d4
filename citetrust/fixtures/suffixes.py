"""A short list of suffix rules for tests and registered queries. Real data need the whole published list."""

from __future__ import annotations

# Public suffixes of more than one label, in the published list's notation
# ("*." any label, "!" exception). A last label that is not listed counts as a suffix by itself.
SHORT_SUFFIXES = tuple(
    """
    ac.at co.at gv.at or.at
    asn.au com.au edu.au gov.au id.au net.au org.au
    ac.be
    com.br edu.br gov.br net.br org.br
    *.ck !www.ck
    ac.cn com.cn edu.cn gov.cn net.cn org.cn
    com.co edu.co gov.co
    com.eg edu.eg
    asso.fr gouv.fr
    com.gr edu.gr gov.gr
    com.hk edu.hk gov.hk org.hk
    ac.id co.id go.id or.id
    ac.il co.il gov.il org.il
    ac.in co.in edu.in gov.in net.in nic.in org.in res.in
    ac.ir
    gov.it edu.it
    ac.jp co.jp ed.jp go.jp gr.jp lg.jp ne.jp or.jp
    ac.ke co.ke
    ac.kr co.kr go.kr or.kr re.kr
    com.mx edu.mx gob.mx org.mx
    com.my edu.my gov.my
    com.ng edu.ng gov.ng
    ac.nz co.nz geek.nz govt.nz net.nz org.nz school.nz
    com.ph edu.ph gov.ph
    com.pk edu.pk gov.pk
    com.pl edu.pl gov.pl net.pl org.pl
    com.pt edu.pt gov.pt
    com.ru edu.ru gov.ru
    com.sa edu.sa gov.sa
    com.sg edu.sg gov.sg
    ac.th co.th go.th or.th
    com.tr edu.tr gov.tr k12.tr org.tr
    com.tw edu.tw gov.tw org.tw
    com.ua edu.ua gov.ua
    ac.uk co.uk gov.uk ltd.uk me.uk net.uk nhs.uk org.uk plc.uk police.uk *.sch.uk
    ac.za co.za gov.za net.za org.za
    """.split()
)
