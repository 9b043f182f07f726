"""A small labelled table of private data, written for training.

A span is marked [kind|text]. Lines without marks are ordinary text with numbers.
"""

LINES = """
please write to [email|anna.berg@example.org] before noon
her address is [email|j_doe+list@mail.example.com] as far as we know
mail [email|carl (at) example (dot) net] for the keys
send it to [email|maria [at] example [dot] org] or ask at the desk
contact [email|info (at) example.com] with questions
reach me under [email|peter.klein (at) firma (dot) de] any time
the form goes to [email|sales[at]example[dot]com] by post
write [email|lena(at)example.fr] today
call [phone|+1 (202) 555-0143] after six
my number is [phone|+44 20 7946 0958] at work
ring [phone|(202) 555-0187] and ask for Ruth
phone [phone|202-555-0111] or come by
tel [phone|555-010-4477], evenings only
fax [phone|030 901820 45] in the office
the line [phone|06 12 34 56 78] is busy
mobile [phone|0171 5550123] please
dial [phone|202.555.0166] for help
tel. [phone|(030) 5550 1234] from nine
our server [ip|10.20.30.40] is down
traffic from [ip|192.0.2.77] was blocked
ping [ip|198.51.100.9] and [ip|203.0.113.25] again
host [ip|198 . 51 . 100 . 23] did not answer
gateway [ip|192[.]0[.]2[.]14] was removed
the card [card|4111 1111 1111 1111] was charged
card number [card|5500-0000-0000-0004] has expired
pay with [card|4012888888881881] now
we kept [card|3782 822463 10005] on file
account [card|4111.1111.1111.1111] is closed
charge [card|6011_0009_9013_9424] once
version 3.11 of the tool came out in 2021
see chapter 12 and pages 100-140 of the book
Licensed under CC BY-NC 4.0.
under the Apache License, Version 2.0.
the GNU General Public License, version 3.
on 2024-05-17 at 10:30 we met 25 people
the price rose from 1,200 to 1.350 in 2 years
room 204 is on floor 2 (left side)
it weighs 3.5 kg and costs 19.99 a piece
a set of 4 (four) costs 12 or 13
token = "9f86d081884c7d659a2feaa0c55ad015" was found
password=3f2a9c1b7e is weak
key AKIA2J5QK7Z9X1 was revoked
the years 1914-1918 and 1939-1945
section 4.2.1 follows section 4.1
add 250 g of flour (type 405) and 2 eggs
the team won 3-1 and 2-0 (away)
in 1999 and in 2005 (twice)
line 17 of file a.txt has 80 columns
order 20231107-55 was sent
10 20 30 40 50 60 were drawn
he said (at last) that dot com firms fail
they met (at noon) in the hall [see note 3]
""".strip().splitlines()
