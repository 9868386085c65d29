"""Digests of the canonical forms of published whole license texts, as in Debian's common-licenses.

Per license: with and without its title lines (CC0 also without the first line only), and where
the terms end in a line that says so, also up to and including that line, and up to it.
"""

DIGESTS = {
    "GPL-2": (
        "d1fa61212ae86f10c1b0ea5c8db2b3512d73899ca35873143cc967722492e2b6",
        "01566cbb89d9e089ad4eeea7bddee1720f26a2bbfe2dca374da5b2f504fa506a",
        "1e95e2d233ff8561dbfd49ec57a5544482a8cc2f9016994498703cf747ecfce1",
        "8fa94d3d812775805528fff117ea835ed908322b039e129b957550c1e107d3e2",
        "0517fbff0c76bac3a1c69298a92fd1a5ef313bce687acf914b862a68ea9ff13c",
        "a268f9c0a6d81f308a4286dac3b04b899da32e1ba02acf6eb78972ce623846e1",
    ),
    "GPL-3": (
        "c3a61fbd56c67082edc0dbea1af43a9ac92d107b35091e88f929121fccfdad83",
        "414e2e60349d760c08c0a57fd8765c39584fac0cc0be0cf5072e15019f3ba664",
        "7070b32ed743efe8b6d87440c2d569e09fb7f02087bd1253d2bc36353aeae588",
        "adb4efb97c89f0f1ab228629e97a8a640f036822e94b45600ba58358df3fc85e",
        "5705ad5a33792a065feda629f2640c63f0ec9b1dd1c1c991ede92050eb26bfdc",
        "351ffb220eb6e5d1e1c80daaf26abb732e29ed85928938c692e709cbee4465ed",
    ),
    "LGPL-2": (
        "a888d77e6cc8e53e11ee3ed23bccf3baaabdb48b46cd0cd50afaae864da4e6b3",
        "7cfa1b23a0c5a29f344a612326db78ab93df5fdb6e5533684b29361c16a5c027",
        "ee00b0b43667799dc552a96dce9a9ff56093ac70d61c154d972f50660201f887",
        "ecdae2920e48a652f7de19348119f5b7649da05cea792245a9927b4072ee4929",
        "69edb8f309032c29e041085adb36c28459b5bc4f7fcaf672df410b0772b5b732",
        "2b46923224b3d27364f38a9abfc6693a109e72e9f30e1e4e4b97457ba07f2e8b",
    ),
    "LGPL-2.1": (
        "f8b1d38ac8ea665fe831af3585b7a2308e9b913f9b67be6f8b9716d7bb485690",
        "d40b087ff245dedbf930b1fff59d1103ae90043d2ee55378c7f0983f53e88da9",
        "148e6979390d985bdd83fe6868101f4c9960e9978dac9c2c3175ea129fdad619",
        "73ae5077bfc0a8d2a45b53767e1217dbd0a7e5f18ca82c7dd9c7fc52037cc44c",
        "14c326b3cd583b3f9eeb70cc977f5907f476a54ca0402cc766b9bb4bbb2caa70",
        "ce490ec474d5d2175d9044553703e136b322dd70dc3fdec08d5ba9a859ba59ef",
    ),
    "LGPL-3": (
        "b9d017245d5b6307f6fc2b6dc02be9744eb7e632f313cf7b809a2cd3996db0f6",
        "4403bce594472355a4c40cb8b3a16e8c209730c66aac27e7f4cdeb4821f67c69",
    ),
    "MPL-2.0": (
        "226b8e7a6a80d84858b644fe20d4ba0730b33860ac582ccf84b10c8ea2a5a324",
        "195b88f44ae1caa84f4d0e533c9ef3662f674af3eccc7f9d3475aae669c9dfdb",
    ),
    "Apache-2.0": (
        "a2e01becc5b012143c0eae8053b94b87e7c2f637dea0364c98ab6db873e5a6f8",
        "421143d5960b9d299b3149bdd097628ae4ad2f6432d3d49e3b4d0d899140c611",
        "434b0c980d6a589d7b58460ceea579869b306a19ea6fdbef0a34d06a3e7098b5",
        "2e349068b1767ce16c09b3a0a7df25513df42a4881a97a2a0de3ecac55c2ce0a",
        "9fbb8c28be2ee964cbe06256ddd322cdf3ce5c7efd6aaeb89268e6a028de52de",
        "d9fe211089c2132237cee118e2f1a7a3eeee0bc0c68216c559e343102c58cd96",
    ),
    "CC0-1.0": (
        "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
        "a142ae38742c8c4c35f5fa19e0a40ebfa60fc38535daf9c570ca3d7e012e1e32",
        "e3ba2aff64372f535373996fe68b166f9e97dc1ead5b471981213ebb8f310ad6",
    ),
}
