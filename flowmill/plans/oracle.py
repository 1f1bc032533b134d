"""Shared SQL for the equivalents: the packet view and what derives from it.

Each name in ``CTE`` is one common table expression; :func:`sql` prefixes a
query with those it needs, in order.
"""

from __future__ import annotations

import re

CTE: dict[str, str] = {}
_NEEDS: dict[str, list[str]] = {}


def define(name: str, text: str, *needs: str) -> None:
    CTE[name] = text
    _NEEDS[name] = list(needs)


def sql(query: str, *needs: str) -> str:
    seen: list[str] = []

    def visit(n: str) -> None:
        for m in _NEEDS[n]:
            visit(m)
        if n not in seen:
            seen.append(n)

    for n in needs:
        visit(n)
    if not seen:
        return query
    parts = []
    for n in seen:
        recursive = re.search(rf"\b(from|join)\s+{n}\b", CTE[n])
        parts.append(f"{n} as {'' if recursive else 'materialized '}({CTE[n]})")
    return "with recursive " + ",\n".join(parts) + "\n" + query


define("packets", """
  select capture, seq, ts_us, ts_us / 1000000e0 t, svc, concat('svc', svc) as label, proto,
         if(up, cip, sip) src_ip, if(up, cport, sport) src_port,
         if(up, sip, cip) dst_ip, if(up, sport, cport) dst_port,
         cast(length(payload_hex) // 2 as int) len, payload_hex
  from (
    select event_id seq, epoch_us(ts) ts_us, cast(floor((day(ts) - 1) / 10.0e0) as int) capture,
           k % 4 svc, case when k % 4 in (0, 3) then 6 else 17 end proto,
           concat('10.', user_id // 65536, '.', user_id // 256 % 256, '.', user_id % 256) cip,
           cast(40000 + user_id % 25000 as int) cport,
           concat('192.168.0.', k % 4) sip, case when k % 4 < 2 then 443 else 53 end sport,
           event_type in ('click', 'signup', 'purchase') up,
           substr(body, cast(1 + 2 * (nb * (i - i // 5) // c) as bigint),
                  cast(2 * (nb * (i + 1 - (i + 1) // 5) // c - nb * (i - i // 5) // c) as bigint)) payload_hex
    from (
      select e.*, cast(json_extract_string(e.props, '$.k') as int) k, b.body, b.nb,
             e.event_no // b.n_slots as i, b.pieces - b.pieces // 5 as c
      from (select *, row_number() over (order by event_id) - 1 event_no from events) e join (
        select slot, hex(encode(text)) body, octet_length(encode(text)) nb, n_slots,
               ((select count(*) from events) - 1 - slot) // n_slots + 1 pieces
        from (select doc_no % n_slots slot, string_agg(text, '' order by doc_no) as text, any_value(n_slots) n_slots
              from (select coalesce(text, '') as text, row_number() over (order by doc_id) - 1 doc_no,
                           least((select count(*) from documents), (select count(*) from events)) n_slots from documents)
              group by 1)) b
      on b.slot = e.event_no % b.n_slots))
""")
define("kept", "select * from packets where not (proto = 17 and (src_port = 53 or dst_port = 53))", "packets")
define("keyed", """
  select *, case when (src_ip, src_port) <= (dst_ip, dst_port)
    then concat_ws('|', capture, proto, src_ip, src_port, dst_ip, dst_port)
    else concat_ws('|', capture, proto, dst_ip, dst_port, src_ip, src_port) end flow_key
  from kept
""", "kept")
define("flowed", """
  select *, first(src_ip) over w cli_ip, first(src_port) over w cli_port,
         first(dst_ip) over w srv_ip, first(dst_port) over w srv_port,
         cast(count(*) over (partition by flow_key) as bigint) n_packets,
         cast(sum(case when len > 0 then 1 else 0 end) over (partition by flow_key) as bigint) n_payload
  from keyed
  window w as (partition by flow_key order by seq)
""", "keyed")
define("assembled", """
  select *, case when src_ip = cli_ip and src_port = cli_port then 1 else -1 end direction
  from flowed where n_payload >= 5
""", "flowed")
define("paid", """
  select *, row_number() over w - 1 as rank, greatest(coalesce(t - lag(t) over w, 1e-6), 1e-6) gap
  from assembled where len > 0
  window w as (partition by flow_key order by seq)
""", "assembled")
define("tokens", """
  select *, cast(least(len, 1500) * direction + 1500 as int) size_token,
         cast(least(greatest(floor(1e0 / (1e0 + exp(-log10(gap))) * 1000), 0), 999) as int) iat_token,
         case when rank < 8 then lower(substr(payload_hex, 1, 128)) end head_hex
  from paid
""", "paid")
define("flow_list", """
  select flow_key, min(capture) capture, min(label) as label, min(proto) proto,
         min(cli_ip) cli_ip, min(cli_port) cli_port, min(srv_ip) srv_ip, min(srv_port) srv_port,
         min(n_packets) n_packets, min(n_payload) n_payload,
         concat(if(min(proto) = 6, 'TCP', 'UDP'), '_', min(cli_ip), '_', min(cli_port), '_',
                min(srv_ip), '_', min(srv_port), '.pcap') file_name
  from flowed group by flow_key
""", "flowed")
