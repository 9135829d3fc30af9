"""DuckDB SQL of the queries that SQL can express."""

#: crc32 of a string by the reflected polynomial: the table is made by the rule, eight steps for each byte.
_CRC = """
crc_table as (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i::bigint, range(8)::bigint[]),
    lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as tab)"""


def _crc32(text: str) -> str:
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, octet_length(encode({text})) + 1),
      lambda k: ('0x' || substr(hex(encode({text})), 2 * k::int - 1, 2))::bigint)),
      lambda c, b: xor(c >> 8, tab[xor(c & 255, b)::int + 1])))"""


#: Near words share a mask: the word with one place blanked, or with a blank put between two places.
_SPELLING = f"""
with recursive {_CRC},
runs as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
counted as (select doc_id, run, count(*) as n from runs where length(run) >= 7 group by all),
hashed as (select run, n, {_crc32("concat(doc_id, ':', run)")} as h from counted, crc_table),
damaged as (select n, case when h % 31 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2)
    else run end as word from hashed),
words as (select word, sum(n)::bigint as n from damaged where length(word) >= 7 group by word having sum(n) >= 2),
places as (select word, n, unnest(range(0, length(word) + 1)) as i from words),
masks as (
  select word, n, 'skip' as kind, left(word, i::int) || '_' || substr(word, i::int + 2) as mask from places where i < length(word)
  union all
  select word, n, 'gap', left(word, i::int) || '_' || substr(word, i::int + 1) from places),
near as (select distinct a.word, b.word as other, b.n from masks a join masks b using (mask)
  where a.word <> b.word and not (a.kind = 'gap' and b.kind = 'gap')),
best as (select word, count(*) as n_near, first(other order by n desc, encode(other)) as other, max(n) as form_n
  from near group by word),
told as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when form_n >= 10 * w.n then other end as form,
  case when form_n >= 10 * w.n then form_n end as form_n from words w left join best b on w.word = b.word),
chain as (select word, word as root from told
  union all select c.word, t.form from chain c join told t on t.word = c.root where t.form is not null),
roots as (select word, last(root order by n) as root from chain join (select word as root, n from words) using (root) group by word)
select word, form, root, n, n_near, form_n from told join roots using (word)
"""



def _edit(state: str, cost: str, letter: str, out: str = "''") -> str:
    """``state`` (nine digits of cost, the audit, chr(1), the repaired text) after one more edit."""
    audit = f"substr({state}, 10, instr({state}, chr(1)) - 10)"
    return (f"(lpad((left({state}, 9)::int + {cost})::varchar, 9, '0') || {audit} || '{letter}' || "
            f"substr({state}, instr({state}, chr(1))) || {out})")


#: Best way to each end of the roles so far, row by row; strings compare by cost, then by audit.
_CONVERSATIONS = f"""
with recursive {_CRC},
planted as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    {_crc32("concat(coalesce(conv_id::varchar, ' '), ':', coalesce(turn::varchar, ' '))")} % 20 as h from conversations, crc_table),
damaged as (select conv_id, turn, case when h = 4 then 'user' else role end as role,
    case when h = 1 then '' when h = 2 then translate(text, '.!?', '') else text end as text,
    unnest(case when h = 3 then [0, 1] else [0] end) as copy from planted where h <> 0),
numbered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as k from damaged),
judged as (select *, left(role, 1) as initial,
    case when not regexp_matches(text, '[^\\x20\\x09-\\x0D]') then 'blank'
      when row_number() over (partition by conv_id, role, text order by k) > 1 then 'duplicate'
      when not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') then 'truncated' else '' end as fault,
    lag(left(role, 1)) over (partition by conv_id order by k) || left(role, 1) as two from numbered),
ids as (select distinct conv_id from conversations),
walk as (
  select conv_id, 0::bigint as k, '000000000' || chr(1) as s, null::varchar as y, null::varchar as u, null::varchar as a from ids
  union all
  select conv_id, k, {_edit("s0", "3", "D")}, least({_edit("y0", "3", "D")}, case when stays and initial = 's' then {_edit("s0", "more", "K", "said")} end),
    least({_edit("u0", "3", "D")}, {", ".join(f"case when stays and initial = 'u' then {_edit(x, 'more', 'K', 'said')} when stays then {_edit(x, 'more + 2', 'R', 'as_user')} end" for x in ("s0", "y0", "a0"))}),
    least({_edit("a0", "3", "D")}, case when stays and initial = 'a' then {_edit("u0", "more", "K", "said")} when stays then {_edit("u0", "more + 2", "R", "as_assistant")} end)
  from (select j.conv_id, j.k, initial, fault in ('', 'truncated') as stays, (fault = 'truncated')::int as more,
      chr(10) || role || ':' || text as said, chr(10) || 'user:' || text as as_user, chr(10) || 'assistant:' || text as as_assistant,
      s as s0, y as y0, u1 as u0, least(a, {_edit("u1", "2", "I", "chr(10) || 'assistant:'")}) as a0
    from (select *, least(u, {", ".join(_edit(x, "2", "I", "chr(10) || 'user:'") for x in ("s", "y", "a"))}) as u1 from walk) w
    join judged j on j.conv_id is not distinct from w.conv_id and j.k = w.k + 1)),
ended as (select conv_id, least(s, a, {_edit("u", "2", "I", "chr(10) || 'assistant:'")},
    {_edit(_edit("y", "2", "I", "chr(10) || 'user:'"), "2", "I", "chr(10) || 'assistant:'")}) as z
  from walk qualify row_number() over (partition by conv_id order by k desc) = 1),
told as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
    count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated, count(*) filter (two not in ('su', 'ua', 'au')) as illegal
  from judged group by conv_id)
select e.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
  coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, left(z, 9)::bigint as cost,
  substr(z, 10, instr(z, chr(1)) - 10) as audit, sha256(substr(z, instr(z, chr(1)) + 2)) as repaired_sha256
from ended e left join told t on t.conv_id is not distinct from e.conv_id
"""

#: Every window as text, its least document, and the words under windows that a smaller document has.
_SUBSTRING = """
with docs as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
windows as (select doc_id, k, array_to_string(w[k:k + 12], ' ') as said
  from (select doc_id, w, unnest(range(1, len(w) - 11)) as k from docs where len(w) >= 13)),
least as (select said, min(doc_id) as low from windows group by said),
hit as (select distinct doc_id, unnest(range(k, k + 13)) as k from windows join least using (said) where low < doc_id),
gone as (select doc_id, list(k) as ks from hit group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(len(ks), 0)::bigint as n_removed,
  sha256(array_to_string(case when ks is null then w else list_filter(w, lambda x, i: not list_contains(ks, i)) end, ' ')) as kept_sha256
from docs left join gone using (doc_id)
"""

ORACLE = {"op11_substring": _SUBSTRING, "op12_conversations": _CONVERSATIONS, "op13_spelling": _SPELLING}
