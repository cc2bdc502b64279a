"""A second reading of mixed timestamps, value by value in Python, against the operator on the driver's smallest and middle tables."""

import datetime as dt
import re
from decimal import Decimal
from pathlib import Path
from zoneinfo import ZoneInfo

import pytest

from tidemark.plans.data_prep import p3_instants

ABB=dict(EST=-300,EDT=-240,CST=-360,CDT=-300,GMT=0,BST=60,CET=60,CEST=120,JST=540,Z=0,UTC=0)
MON={m:i+1 for i,m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
def parse(t,zone,order):
    if t is None: return None
    t=t.strip(' \t\r\n"\xa0')
    if re.fullmatch(r'\d+(\.\d+)?([eE]\+?\d+)?',t):
        v=Decimal(t)
        for p in (1,10**3,10**6,10**9):
            if 315532800<=v/p<=7258118400: return int(v*10**6//p)
        return None
    m=re.search(r'\[[^\]]*\]$',t)
    if m: t=t[:m.start()]
    off=None
    m=re.search(r'(?:UTC)?([+-])(\d\d):?(\d\d)?$',t)
    has=False
    body=t
    if m and re.search(r'\d\d:?\d\d|[AaPp][Mm]',t[:m.start()]) and re.search(r':\d\d|T\d{4}',t[:m.start()]):
        off=(int(m[2])*60+int(m[3] or 0))*(1 if m[1]=='+' else -1); body=t[:m.start()].strip(); 
        if body.endswith('UTC'): body=body[:-3].strip()
    else:
        m=re.search(r'([A-Za-z]+)$',t)
        if m and m[1].upper() not in('AM','PM'):
            a=m[1].upper()
            if a in ABB: off=ABB[a]; body=t[:m.start()].strip()
            elif a[:2] in('AM','PM') and a[2:] in ABB: off=ABB[a[2:]]; body=t[:m.start()+2]
            else: return None
    ap=None
    m=re.search(r'\s*([AaPp][Mm])$',body)
    if m: ap=m[1].upper(); body=body[:m.start()]
    m=re.search(r'(?:[T _]|\s)(\d{1,2}):(\d\d)(?::(\d\d)(?:[.,](\d+))?)?$',body) 
    if m: H,M,S,f=int(m[1]),int(m[2]),int(m[3] or 0),(m[4] or ''); d=body[:m.start()]
    else:
        m=re.search(r'T(\d\d)(\d\d)(\d\d)$',body)
        if not m: return None
        H,M,S,f=int(m[1]),int(m[2]),int(m[3]),''; d=body[:m.start()]
    if ap:
        if not 1<=H<=12: return None
        H=H%12+(12 if ap=='PM' else 0)
    if H>23 or M>59 or S>59: return None
    try:
        if x:=re.fullmatch(r'(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})',d): day=dt.date(*map(int,x.groups()))
        elif x:=re.fullmatch(r'(\d{4})(\d\d)(\d\d)',d): day=dt.date(*map(int,x.groups()))
        elif x:=re.fullmatch(r'(\d{4})-W(\d\d)-(\d)',d): day=dt.date.fromisocalendar(*map(int,x.groups()))
        elif x:=re.fullmatch(r'(\d{4})-(\d{3})',d):
            day=dt.date(int(x[1]),1,1)+dt.timedelta(int(x[2])-1)
            if day.year!=int(x[1]): return None
        elif x:=re.fullmatch(r'(\d{1,2})[./-](\d{1,2})[./-](\d{4}|\d\d)',d):
            a,b,c=x.groups()
            if order=='dmy': day=dt.date(int(c)+(2000 if len(c)==2 else 0),int(b),int(a))
            elif order=='mdy': day=dt.date(int(c)+(2000 if len(c)==2 else 0),int(a),int(b))
            elif len(c)==2: day=dt.date(2000+int(a),int(b),int(c))
            else: return None
        elif x:=re.fullmatch(r'(?:[A-Za-z]{3}, )?(\d{1,2})[- ]([A-Za-z]{3})[- ](\d{4})',d): day=dt.date(int(x[3]),MON[x[2].lower()],int(x[1]))
        else: return None
    except (ValueError,KeyError): return None
    loc=dt.datetime(day.year,day.month,day.day,H,M,S); us=int((f+'000000')[:6])
    ep=dt.datetime(1970,1,1)
    if off is not None: return ((loc-ep)//dt.timedelta(seconds=1)-off*60)*10**6+us
    z=ZoneInfo(zone); c=set()
    for fold in (0,1):
        u=loc.replace(tzinfo=z,fold=fold).astimezone(dt.timezone.utc)
        if u.astimezone(z).replace(tzinfo=None)==loc: c.add(u)
    if len(c)!=1: return None
    return int(c.pop().timestamp())*10**6+us


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_every_record(spark, folder):
    if not Path(folder).exists():
        pytest.skip("no test tables here")
    import duckdb

    rows = duckdb.sql(f"SELECT rec_id, r.timestamp, zone, date_order FROM '{folder}/qqq_1m_raw.parquet' r LEFT JOIN '{folder}/feeds.parquet' f USING (feed)").fetchall()
    got = {r["rec_id"]: r["ts_us"] for r in p3_instants(spark, folder).collect()}
    assert got == {i: parse(t, zone, order) for i, t, zone, order in rows}
